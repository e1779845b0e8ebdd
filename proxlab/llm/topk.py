"""Exact top-k inner-product search with norm buckets (operator 9).

Candidates are grouped by length (Euclidean norm) into at most ``BUCKETS`` buckets at quantiles of the
norm; a bucket larger than ``block_rows`` (equal vectors share a norm) is dealt by hash into blocks.
Queries are dealt into blocks of ``query_rows``.  The longest bucket is searched first and gives every
query a lower bound, its k-th best score so far.  Every other block is then searched with it: for a block
whose longest vector has length l, the bound divided by |q| l is the local cosine threshold t.

* t > 1: nothing in the block can reach the bound; the query skips it.
* t >= ``COORDINATE_FROM``: coordinate pruning.  In the query's largest coordinate a vector of cosine
  >= t must lie within an interval, found by binary search in the block's values of that coordinate.
* otherwise: length pruning.  Only vectors of length >= bound / |q| are looked at.

What survives is verified by exact products.  Pruning keeps candidates equal to the bound, so ties are
decided by id at the end.  A task holds one block of candidates and one of queries; it returns at most k
rows a query.

Components become floor(scale * x).  A row takes part if its id and vector are not null and all
components are finite; only vectors of equal length (dimension) are compared.  A query's own id is never
among its results; other repeated rows are candidates of their own.  Products that might exceed 2**53
are computed with whole numbers of any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, prepare

BUCKETS, BLOCK_ROWS, QUERY_ROWS = 64, 2048, 2048
COORDINATE_FROM = 0.6
RESULT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, key: str, col: str, scale: int) -> DataFrame:
    """[id, v: array<long>, norm] of the rows that take part."""
    x = F.col(col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return (vectors.where(F.col(key).isNotNull() & x.isNotNull() & fine)
            .select(F.col(key).cast("long").alias("id"), v.alias("v")).withColumn("norm", norm))


def matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.int64) if len(rows) else np.zeros((0, 0), np.int64)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact q @ c.T of integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(object) @ c.astype(object).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id (``ids`` ascend)."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.r_[above, np.flatnonzero(scores == least)[:k - len(above)]]
        return ids[at], scores[at]
    return ids, scores


def search_block(cid: np.ndarray, c: np.ndarray, cnorm: np.ndarray, qid: np.ndarray, q: np.ndarray, qnorm: np.ndarray,
                 floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """At most k results of each query in one block; ``floor``: lower bound of its k-th score (-inf if unknown)."""
    order = np.argsort(cid, kind="stable")
    cid, c, cnorm = cid[order], c[order], cnorm[order]
    longest = cnorm.max()
    slack = 1 + 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        t = floor / (qnorm * longest)
    t = np.where(np.isfinite(t), t, -1.0)  # no bound yet, or a zero vector
    out: list[tuple[int, int, int]] = []

    def take(i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != qid[i]
        ids, scores = best(scores[other], ids[other], k)
        out.extend((int(qid[i]), int(a), int(s)) for a, s in zip(ids, scores, strict=True))

    live = t <= slack
    by_coordinate = live & (t >= COORDINATE_FROM)
    if by_coordinate.any():
        unit = c / np.maximum(cnorm, 1e-300)[:, None]
        ranked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in np.flatnonzero(by_coordinate):
            f = int(np.abs(q[i]).argmax())
            if f not in ranked:
                o = np.argsort(unit[:, f], kind="stable")
                ranked[f] = (o, unit[o, f])
            o, value = ranked[f]
            x, low = q[i, f] / qnorm[i], min(1.0, t[i])
            spread = np.sqrt(max(0.0, (1 - x * x) * (1 - low * low)))
            # all with x * y + sqrt((1 - x^2)(1 - y^2)) >= low
            a = -1.0 if x <= -low else x * low - spread
            b = 1.0 if x >= low else x * low + spread
            at = np.sort(o[np.searchsorted(value, a - 1e-9):np.searchsorted(value, b + 1e-9, side="right")])
            if len(at):
                take(i, cid[at], products(q[i:i + 1], c[at])[0])
    by_length = np.flatnonzero(live & ~by_coordinate)
    for lo in range(0, len(by_length), 256):
        some = by_length[lo:lo + 256]
        # vectors long enough for at least one of these queries
        need = np.where(floor[some] > 0, floor[some] / np.maximum(qnorm[some], 1e-300), 0.0).min() / slack
        at = np.flatnonzero(cnorm >= need)
        if len(at):
            for i, scores in zip(some, products(q[some], c[at]), strict=True):
                take(i, cid[at], scores)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", col: str = "embedding", scale: int = 256,
           block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """[query_id, rank, vec_id, score] for the rows where ``is_query`` (over ``id``) holds, against all rows."""
    prepare(vectors)
    spark = vectors.sparkSession
    rows = held(quantized(vectors, key, col, scale).withColumn("dim", F.size("v")))
    n_queries = rows.where(is_query).count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cuts = sorted(set(rows.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.25 / BUCKETS)), reverse=True)
    # bucket 0 holds the longest vectors
    bucket = F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda cut: cut > F.col("norm")))
    sorted_rows = rows.withColumn("bucket", bucket)
    counts = {(r["dim"], r["bucket"]): r["count"] for r in sorted_rows.groupBy("dim", "bucket").count().collect()}
    total = {}
    for (dim, _), n in counts.items():
        total[dim] = total.get(dim, 0) + n
    first = {}  # per dimension, buckets up to this one are searched first: the longest few vectors
    for dim in total:
        seen = 0
        for b in sorted(b for d, b in counts if d == dim):
            seen += counts[dim, b]
            first.setdefault(dim, b) if seen >= max(4 * k, total[dim] // BUCKETS) else None
        first.setdefault(dim, len(cuts))
    layout = [(d, b, -(-n // block_rows), int(b <= first[d])) for (d, b), n in counts.items()]
    blocks = spark.createDataFrame(layout, "dim int, bucket int, parts int, head int")
    n_query_blocks = max(1, -(-n_queries // query_rows))
    spread = F.xxhash64("id", "v")
    cands = (sorted_rows.join(F.broadcast(blocks), ["dim", "bucket"])
             .withColumn("part", F.pmod(spread, F.col("parts")).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))))
    queries = rows.where(is_query).withColumn("qb", F.pmod(spread, F.lit(n_query_blocks)).cast("int")).select("id", "v", "norm", "dim", "qb")
    on = ["dim", "bucket", "part", "qb"]

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(c) and len(q):
            found = search_block(c["id"].to_numpy(), matrix(c["v"]), c["norm"].to_numpy(), q["id"].to_numpy(), matrix(q["v"]),
                                 q["norm"].to_numpy(), q["floor"].to_numpy(np.float64), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def phase(head: int, with_floor: DataFrame) -> DataFrame:
        # at most BUCKETS + 1 rows a dimension are broadcast; a bucket's parts are counted out afterwards
        asked = (with_floor.join(F.broadcast(blocks.where(F.col("head") == head)), "dim")
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        # new names for the queries' columns: both sides come from the same rows
        asked = asked.select(*[F.col(c).alias(c) for c in ("id", "v", "norm", "floor", *on)])
        return (cands.where(F.col("head") == head).select("id", "v", "norm", *on).groupBy(*on)
                .cogroup(asked.groupBy(*on)).applyInPandas(run, RESULT))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    head = held(ranked(phase(1, queries.withColumn("floor", F.lit(float("-inf"))))))
    floors = head.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor")).distinct()
    rest = phase(0, queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    return ranked(head.select("query_id", "vec_id", "score").unionAll(rest)).select("query_id", "rank", "vec_id", "score")

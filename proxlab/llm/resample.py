"""Importance resampling towards a target distribution (operator 11).

Documents are described by hashed word n-grams.  A bucket's gain is 1000 times the log ratio of its smoothed share in the
target texts and in the documents; a document's weight is the sum of its features' gains.  Adding Gumbel noise, which
only a seed and the document's key decide, and keeping the highest scores draws documents without
replacement in proportion to exp(weight / 1000).

Words: a table of 256 bytes lower-cases A-Z and turns every byte but digits, letters and bytes of non-ASCII characters
into a blank; ``bytes.split`` gives the words.  The crc32 of an n-gram (words joined by one space) continues that of its
first n - 1 words, so longer n-grams cost one call each.  Counters reduce features within a task to one count a
bucket, which Spark sums: at most ``buckets`` counts per task and in all, the only numbers that reach the driver.

Plan: two narrow passes over the texts (counts, then weights); the narrow scores are written, and the rows that may be
drawn are ranged by score to number them (``common.numbered``).  Texts are never shuffled.  A text is split in
pieces of ``PIECE_BYTES``, so memory doesn't grow with its length.

Null and empty texts have no feature and weight 0.  A null key is hashed as an empty one and comes first
among equal scores; repeated rows are scored, drawn and returned as rows of their own.  An empty target or corpus has
no features (all gains then follow from the smoothing); an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_array, numbered, prepare, saved

MAX_N, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
PIECE_BYTES = 1 << 20
#: distinct features that a task counts before it folds them into buckets
FOLD = 1 << 19
#: digits, lower-cased letters and bytes of non-ASCII characters stay, the rest becomes a blank
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    data = (text or "").encode().translate(TABLE)
    lo = 0
    while len(data) - lo > PIECE_BYTES:
        cut = data.find(b" ", lo + PIECE_BYTES)
        if cut < 0:
            break
        yield data[lo:cut].split()
        lo = cut
    yield data[lo:].split()


def feature_hashes(text: str | None, max_n: int = MAX_N) -> Iterator[tuple[int, list[int]]]:
    """(words, crc32 of all runs of 1 .. max_n words that end in them) of each piece of a text."""
    before: list[bytes] = []
    for words in word_pieces(text):
        out = list(map(crc32, words))
        if max_n > 1:
            line = before + words
            run = list(map(crc32, line))
            for n in range(2, max_n + 1):
                run = list(map(crc32, line[n - 1:], map(crc32, repeat(b" "), run)))
                # runs that end before this piece were counted with the one before
                out += run[max(0, len(before) - n + 1):]
            before = line[max(0, len(line) - max_n + 1):]
        yield len(words), out


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket in all texts."""
    prepare(texts)

    def run(batches):
        total, part = np.zeros(buckets, np.int64), Counter()

        def fold():
            keys, n = (np.fromiter(x, np.int64, len(part)) for x in (part.keys(), part.values()))
            total[:] += np.bincount(keys % buckets, n, buckets).astype(np.int64)
            part.clear()

        for batch in batches:
            for t in batch.column(0):
                for _, hashes in feature_hashes(t.as_py(), max_n):
                    part.update(hashes)
                    if len(part) > FOLD:
                        fold()
        fold()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    sums = texts.select(texts[f"`{text_col}`"].cast("string").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share of the target over that of the documents), per bucket, in doubles."""
    all_own, all_target = float(own.sum() + len(own)), float(target.sum() + len(own))
    return np.array([floor(1000 * log(((t + 1.0) * all_own) / ((s + 1.0) * all_target)))
                     for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", max_n: int = MAX_N) -> DataFrame:
    """``docs`` without its text and with n_words, n_features and weight."""
    made = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
    taken = {text_col.lower(), *(f.name for f in made)}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *made])
    shared = prepare(docs).sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for i, t in enumerate(column_array(batch, "_text")):
                for n, hashes in feature_hashes(t.as_py(), max_n):
                    out[i] += n, len(hashes), gain[np.array(hashes, np.int64) % len(gain)].sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(kept))), *(pa.array(out[:, j]) for j in range(3))], names=schema.names)

    narrow = docs.select(*[docs[f"`{f.name}`"].alias(f"c{i}") for i, f in enumerate(kept)], docs[f"`{text_col}`"].cast("string").alias("_text"))
    return narrow.mapInArrow(run, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """1000 times standard Gumbel noise, floored, from the first 32 bits of sha256(seed:key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, key: str = "doc_id", text_col: str = "text",
             target_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """[key, n_words, n_features, weight, score, rank] of every row; rank (from 1) of the drawn ones, else null.

    Of the rows with at least ``min_words`` words, ``percent`` % (rounded down) with the highest scores are drawn, the
    smaller key first among equal scores.
    """
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets))
    narrow = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text_col}`"].cast("string").alias("text"))
    scored = saved(weigh(narrow, gain, "text", max_n).withColumn("score", F.col("weight") + gumbel(F.col("k"), seed)), "weights")
    able = F.col("n_words") >= min_words
    ordered, n = numbered(scored.where(able), [-F.col("score"), F.col("k")], "rank", "ranked")
    drawn = n * percent // 100
    ranked = ordered.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    out = ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("k").alias(key), "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` (whole rows, by key)."""
    ranked = resample(docs, target, key=key, **options).where("rank IS NOT NULL").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(ranked, docs[f"`{key}`"] == F.col("_drawn"), "left_semi")

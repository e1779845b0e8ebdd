"""Toxicity by class-conditional Kneser-Ney models (operator 1).

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary documents.  A class's
bigram counts back off to its own continuation counts (in how many contexts a word occurs), first of the
word, then of its beginnings of 6 and 4 bytes, and those back off to counts shared by both classes (in how
many of the classes a beginning occurs; likewise, how a beginning's share is dealt among its words).  So a
rare word speaks through its relatives, and an expression that either class has seen once or twice weighs
little in the comparison, however often the frequent ones occur.  A document's evidence is the difference of its
length-normalized log-likelihoods under the two models, over the whole document and over its most toxic
short windows (a few insults in a long text would drown in its mean).  A logistic calibration, fitted on
labelled rows kept out of the counts, turns the evidence into a score in 0..1.

Fitting reads a bounded sample of the labelled rows: at most ``max_rows`` documents and ``max_bytes`` of text per
class, by hash order of their ids; single texts over a sixteenth of ``max_bytes`` are not learned from.  Counting is a Spark aggregation; every word, beginning, context and bigram of the counted
documents reaches the driver, and every worker, as sorted 64-bit hashes with a 32-bit ratio (12 bytes each),
so the sample alone bounds them.  Scoring is one narrow pass over whole texts.

Words are runs of digits, a-z and non-ASCII characters after lowering A-Z.  Null or word-less texts have
no evidence and score the base rate.  A document labelled more than once counts as toxic if any label says
so; null labels and labels without a document are ignored.  Without labels of both classes every score is
the base rate.  Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_array, held, prepare, saved, span_hashes, text_buffer, text_slices, word_spans
from .decontaminate import FOLD

MAX_ROWS, MAX_BYTES = 10_000, 32 << 20
STEMS = (6, 4)  # bytes of a word's beginnings
WINDOWS = (1, 4, 16)
THRESHOLD = 0.3
CALIBRATION_PARTS = 4  # one labelled document in so many calibrates instead of being counted
FOLD_TABLE = np.frombuffer(FOLD, np.uint8)
WORD_BYTES = np.arange(256) != 32


@dataclass
class Model:
    base: float
    unseen: float = 0.0                 # log ratio of the continuation models for an unseen word
    units: tuple | None = None          # for words, then each beginning: sorted hashes, log ratios of the continuation models
    contexts: tuple | None = None       # sorted hashes of contexts, log ratios of their back-off weights
    bigrams: tuple | None = None        # sorted keys of bigrams, their log ratios
    weights: np.ndarray | None = None   # calibration


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of each word and its beginnings as signed longs, words per row)."""
    low = FOLD_TABLE[buf]
    starts, ends, n = word_spans(low, offsets, WORD_BYTES)
    return [span_hashes(low, starts, e).view(np.int64) for e in (ends, *(np.minimum(ends, starts + size) for size in STEMS))], n


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of neighbouring words."""
    return h ^ (w << 1)


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of each key in a sorted table."""
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at]


def count_pairs(sample: DataFrame, text_col: str) -> DataFrame:
    """[h, w, s6, s4, toxic, plain]: bigram counts of the sample by class, with the second word's beginnings."""
    names = ["h", "w", *(f"s{size}" for size in STEMS)]

    def run(batches):
        for batch in batches:
            label = np.asarray(column_array(batch, "toxic")).astype(np.int64)
            buf, offsets = text_buffer(column_array(batch, text_col))
            for lo, hi, b, off in text_slices(buf, offsets):
                (words, *stems), n = words_of(b, off)
                if len(words) < 2:
                    continue
                row = np.repeat(np.arange(lo, hi), n)
                same = row[1:] == row[:-1]
                toxic = label[row[1:][same]]
                units = [words[:-1][same], words[1:][same], *(x[1:][same] for x in stems)]
                _, at, where = np.unique(pair_keys(*units[:2]), return_index=True, return_inverse=True)
                t, every = np.bincount(where, toxic).astype(np.int64), np.bincount(where)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in units), pa.array(t), pa.array(every - t)], names=[*names, "toxic", "plain"])

    return (sample.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "toxic", "plain"])).groupBy(*names)
            .agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")))


def counted(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def discounts(frame: DataFrame, columns: tuple[str, str], *more: Column) -> tuple[list[float], list]:
    """Kneser-Ney discounts n1 / (n1 + 2 n2) of two columns of counts, and further aggregates of the same pass."""
    n = list(frame.agg(*[counted(F.col(c) == k) for c in columns for k in (1, 2)], *more).first())
    return [max(0.1, (a or 0) / max(1, (a or 0) + 2 * (b or 0))) for a, b in (n[0:2], n[2:4])], n[4:]


def continuation(pairs: DataFrame) -> tuple[list[DataFrame], float]:
    """Per unit size (word, then shorter beginnings) [unit, lt, lp, ratio]; and the ratio of what is wholly unknown.

    lt and lp are the probabilities under the classes' continuation models, ``ratio`` the log ratio that a
    word not seen itself, but with this as its longest known beginning, has.
    """
    t, p = F.col("toxic"), F.col("plain")
    chain = ["w", *(f"s{size}" for size in STEMS)]
    # written, not cached: the tables below are built from it again and again, and their plans stay short
    level = saved(pairs.groupBy(*chain).agg(counted(t > 0).alias("ct"), counted(p > 0).alias("cp")), "word-contexts")
    n = level.agg(F.sum("ct"), F.sum("cp")).first()
    nt, np_ = max(1, n[0] or 0), max(1, n[1] or 0)
    classes = (F.col("ct") > 0).cast("int") + (F.col("cp") > 0).cast("int")
    frames, weights = {}, {}
    for i in reversed(range(len(chain))):  # the shortest beginning first
        frame = level.groupBy(*chain[i:]).agg(F.sum("ct").alias("ct"), F.sum("cp").alias("cp")).withColumn("classes", classes)
        (dt, dp), size = discounts(frame, ("ct", "cp"), F.sum("classes"), F.count("*"), counted(F.col("ct") > 0), counted(F.col("cp") > 0))
        total, units, t_units, p_units = (max(1, x or 0) for x in size)
        weights[i] = (dt * t_units / nt, dp * p_units / np_)
        if i == len(chain) - 1:
            rest = 0.5 * units / total / (units + 1)  # kept for beginnings that neither class has seen
            under = frame.withColumn("st", (F.col("classes") - 0.5) / total + rest).withColumn("sp", F.col("st"))
        else:
            parent = chain[i + 1]
            dealt = frame.groupBy(parent).agg(F.sum("classes").alias("dealt"))
            share = F.col("classes") / F.col("dealt")
            under = (frame.join(dealt, parent).join(frames[i + 1].select(F.col("unit").alias(parent), "lt", "lp"), parent)
                     .withColumn("st", F.col("lt") * share).withColumn("sp", F.col("lp") * share).drop("lt", "lp"))
        own = lambda c, d, whole: F.greatest(F.col(c) - d, F.lit(0.0)) / whole
        frames[i] = under.select(F.col(chain[i]).alias("unit"), (own("ct", dt, nt) + weights[i][0] * F.col("st")).alias("lt"),
                                      (own("cp", dp, np_) + weights[i][1] * F.col("sp")).alias("lp"))
    back = 0.0  # log ratio of the weights on the way down to a unit
    out = []
    for i in range(len(chain)):
        out.append(frames[i].withColumn("ratio", F.log(F.col("lt") / F.col("lp")) + F.lit(back)))
        back += float(np.log(weights[i][0] / weights[i][1]))
    return out, back


def count_models(pairs: DataFrame) -> tuple:
    """(tables of words and beginnings, of contexts, of bigrams, ratio of the unknown) of the two models; tables as in ``Model``."""
    units, unknown = continuation(pairs)
    t, p = F.col("toxic"), F.col("plain")
    (dt, dp), _ = discounts(pairs, ("toxic", "plain"))
    # back-off weights of the contexts
    ctx = pairs.groupBy("h").agg(F.sum("toxic").alias("ht"), F.sum("plain").alias("hp"), counted(t > 0).alias("nt"), counted(p > 0).alias("np"))
    back = lambda n, d, h: F.when(F.col(h) > 0, d * F.col(n) / F.col(h)).otherwise(F.lit(1.0))
    ctx = ctx.select("h", "ht", "hp", back("nt", dt, "ht").alias("bt"), back("np", dp, "hp").alias("bp"))
    words, *lt_lp, ratio = sorted_columns(units[0].select("unit", "lt", "lp", "ratio"))
    heads, *of_heads = sorted_columns(ctx)
    # every pair meets its word and context in a narrow pass: joins would shuffle the pairs twice
    shared = pairs.sparkSession.sparkContext.broadcast((words, lt_lp, heads, of_heads))

    def run(batches):
        words, (lt, lp), heads, (ht, hp, bt, bp) = shared.value
        own = lambda c, d, h: np.maximum(c - d, 0.0) / np.maximum(h, 1)
        for batch in batches:
            h, w, toxic, plain = (column_array(batch, n).to_numpy() for n in ("h", "w", "toxic", "plain"))
            i, j = np.searchsorted(words, w), np.searchsorted(heads, h)
            seen = np.log(own(toxic, dt, ht[j]) + bt[j] * lt[i]) - np.log(own(plain, dp, hp[j]) + bp[j] * lp[i])
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(h, w)), pa.array(seen)], names=["key", "ratio"])

    bigrams = sorted_table(pairs.select("h", "w", "toxic", "plain").mapInArrow(run, "key long, ratio double"))
    shared.destroy()
    tables = [(words, ratio.astype(np.float32)), *(sorted_table(u.select("unit", "ratio")) for u in units[1:])]
    return tables, (heads, np.log(of_heads[2] / of_heads[3]).astype(np.float32)), bigrams, unknown


def evidence(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: 1, mean log ratio of the document, of its most toxic window of each size, log length."""
    (words, *stems), n = words_of(buf, offsets)
    out = np.zeros((len(n), 3 + len(WINDOWS)))
    out[:, 0], out[:, -1] = 1, np.log1p(n)
    if not len(words):
        return out
    ratio, open_ = np.full(len(words), model.unseen), np.arange(len(words))
    for table, unit in zip(model.units, (words, *stems), strict=True):  # the longest known beginning decides
        known, value = look_up(table, unit[open_])
        ratio[open_[known]] = value[known]
        open_ = open_[~known]
    row = np.repeat(np.arange(len(n)), n)
    if len(words) > 1:
        known, value = look_up(model.bigrams, pair_keys(words[:-1], words[1:]))
        met, back = look_up(model.contexts, words[:-1])
        better = np.where(known, value, ratio[1:] + np.where(met, back, 0.0))
        ratio[1:] = np.where(row[1:] == row[:-1], better, ratio[1:])
    total = np.r_[0.0, np.cumsum(ratio)]
    last = np.cumsum(n)
    first = last - n
    full = n > 0
    out[full, 1] = (total[last] - total[first])[full] / n[full]
    for k, size in enumerate(WINDOWS):
        # a window that starts at each word; near the end of a document the last whole window again
        start = np.arange(len(words))
        start = np.maximum(np.minimum(start, last[row] - size), first[row])
        end = np.minimum(start + size, last[row])
        out[full, 2 + k] = np.maximum.reduceat((total[end] - total[start]) / (end - start), first[full])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps (few columns)."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    scale[0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w / scale


def sorted_columns(frame: DataFrame) -> list[np.ndarray]:
    """The columns of a frame, sorted by the first."""
    table = frame.toArrow()
    columns = [c.to_numpy() for c in table.columns]
    del table
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def sorted_table(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    key, ratio = frame.columns
    keys, ratios = sorted_columns(frame.select(key, F.col(ratio).cast("float")))
    return keys, ratios


def with_evidence(rows: DataFrame, shared, text_col: str, keep: list[str]) -> DataFrame:
    fields = [rows.schema[n] for n in keep]
    schema = T.StructType([*fields, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(column_array(batch, text_col))
            parts = [evidence(shared.value, b, off) for _, _, b, off in text_slices(buf, offsets)]
            x = np.concatenate(parts) if parts else np.zeros((0, 3 + len(WINDOWS)))
            yield pa.RecordBatch.from_arrays([*(column_array(batch, n) for n in keep), pa.array(list(x), pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES):
    """A broadcast ``Model`` learned from at most ``max_rows`` labelled documents and ``max_bytes`` of text per class.

    ``usable`` (over the labels' columns) says which labels may be learned from.
    """
    prepare(docs)
    spark = docs.sparkSession
    rows = labels if usable is None else labels.where(usable)
    one = rows.where(F.col(key).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label_col).cast("int").alias("toxic"))
    one = held(one)
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return spark.sparkContext.broadcast(Model(base))
    part = F.pmod(F.xxhash64("k"), F.lit(CALIBRATION_PARTS))
    picked = [one.where(F.col("toxic") == c).orderBy(F.xxhash64("k", F.lit(1)), "k").limit(max_rows) for c in (0, 1)]
    picked = held(picked[0].unionAll(picked[1]).withColumn("counted", part != 0))
    named = docs.select(F.col(key).alias("k"), F.col(text_col).alias("text"))
    # at most 2 max_rows sizes; the texts of what fits are then read and kept
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    sizes = named.join(F.broadcast(picked), "k").groupBy("k", "toxic").agg(size.alias("size")).where(F.col("size") <= max_bytes // 16)
    upto = Window.partitionBy("toxic").orderBy(F.xxhash64("k", F.lit(1)), "k").rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= max_bytes)
    picked_fit = held(picked.join(F.broadcast(fits.select("k")), "k"))
    texts = held(named.join(F.broadcast(picked_fit), "k"))
    pairs = held(count_pairs(texts.where("counted"), "text"))
    units, contexts, bigrams, unknown = count_models(pairs)
    model = Model(base, unknown, tuple(units), contexts, bigrams)
    shared = spark.sparkContext.broadcast(model)
    rest = with_evidence(texts.where("NOT counted"), shared, "text", ["toxic"]).toArrow()
    shared.destroy()
    y = rest["toxic"].to_numpy().astype(np.float64)
    for frame in (one, picked, picked_fit, texts, pairs):
        frame.unpersist()
    if not 0 < y.sum() < len(y):
        return spark.sparkContext.broadcast(Model(base))
    # the sample holds up to max_rows of either class: weigh the intercept back to the base rate
    model.weights = logistic(np.array(rest["x"].to_pylist()), y)
    drawn = y.mean()
    model.weights[0] += np.log(base / (1 - base)) - np.log(drawn / (1 - drawn))
    return spark.sparkContext.broadcast(model)


def score(docs: DataFrame, shared, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with [score, predicted] added (replacing columns of those names)."""
    prepare(docs)
    made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    schema = T.StructType(kept + made)

    def run(batches):
        model = shared.value
        for batch in batches:
            buf, offsets = text_buffer(column_array(batch, text_col))
            p = np.full(len(offsets) - 1, model.base)
            if model.weights is not None:
                for lo, hi, b, off in text_slices(buf, offsets):
                    x = evidence(model, b, off)
                    p[lo:hi] = np.where(x[:, -1] > 0, 1 / (1 + np.exp(-np.clip(x @ model.weights, -35, 35))), model.base)
            yield pa.RecordBatch.from_arrays([*(column_array(batch, f.name) for f in kept), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*[docs[f"`{f.name}`"] for f in kept]).mapInArrow(run, schema)

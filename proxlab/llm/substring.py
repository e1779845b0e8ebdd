"""Removal of repeated word windows by de Bruijn path compaction (operator 2).

The graph: an edge is a window of ``window`` consecutive words of a document, from its first
``window - 1`` words to its last.  Each edge has a minimizer, the smallest hash among its runs of
``core`` words; consecutive edges of a document that share one minimizer occurrence form a path segment
(at most ``window - core + 1`` edges), the unit that is compacted:

1. One pass over the texts cuts every document into path segments, one row each instead of one per edge.
2. Rows meet by minimizer.  Equal edges have equal minimizers, so whatever repeats meets here.  Segments
   with equal words are one path: all edges of all but its first occurrence start earlier elsewhere.
   If the minimizer has only one path, the path does not branch and is settled as a whole.
3. Where several different paths share a minimizer (the ends of repeated spans, mostly), the first
   occurrence of each is taken apart: its source coordinates are joined back to the text, its edges are
   hashed singly, and equal edges are joined to find the earliest.
4. The coordinates of all repeated edges are joined to their documents, where they merge into long spans,
   and the covered words go.

Segments and edges are told apart by two independent 64-bit hashes.  A segment that occurs often within
a batch is pre-aggregated there: only its first occurrence is shuffled by minimizer, later ones are
known to repeat.  So a passage that a third of all documents share sends one row per batch to its group.

"Earlier" means smaller document id, or earlier start in the same document.  A null text has no words.
Documents with a null id are returned whole and remove nothing.  Rows that share an id are one document
if their texts are equal (all of them get the same result) and are ordered by a text tag if not.
Columns besides id and text are not used and do not clash.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE_A, BASE_B, U64, column_array, prepare, saved, span_hashes, text_buffer, text_slices, word_hashes, word_spans

WINDOW, CORE = 20, 10
#: a coordinate packs text tag (16 bits), first word (40 bits) and edge count (7 bits)
TAG_BITS, COUNT_BITS, START_BITS = 16, 7, 40
SEGMENT_SCHEMA = "m long, s long, doc long, at long"


def text_tag(text):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - TAG_BITS)


def coordinate(tag: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (tag << (START_BITS + COUNT_BITS)) | (start << COUNT_BITS) | count


def tag_of(at):
    return F.shiftright(at, START_BITS + COUNT_BITS)


def place_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (at >> COUNT_BITS) & ((1 << START_BITS) - 1), at & ((1 << COUNT_BITS) - 1)


def path_segments(buf: np.ndarray, offsets: np.ndarray, window: int, core: int):
    """(minimizer, segment hash, row, first word in the row, edges) of all path segments of some texts."""
    starts, ends, n = word_spans(buf, offsets)
    total = len(starts)
    z = np.zeros(0, np.int64)
    if total < window:
        return z.view(U64), z.view(U64), z, z, z
    wa, wb = word_hashes(buf, starts, ends, BASE_A), word_hashes(buf, starts, ends, BASE_B)
    begin = np.arange(total - core + 1)
    cores = span_hashes(wa, begin, begin + core, BASE_A)
    edges = total - window + 1
    low, where = cores[:edges].copy(), np.arange(edges)
    for step in range(1, window - core + 1):
        other = cores[step:step + edges]
        less = other < low
        low[less] = other[less]
        where[less] = np.flatnonzero(less) + step
    row = np.repeat(np.arange(len(n)), n)
    valid = row[:edges] == row[window - 1:]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (where[1:] != where[:-1]) | (row[1:edges] != row[:edges - 1])
    first = np.flatnonzero(new)
    if not len(first):
        return z.view(U64), z.view(U64), z, z, z
    # a segment ends before the next one or before the first invalid edge after it
    bad = np.flatnonzero(~valid)
    stop = np.r_[bad, edges][np.searchsorted(bad, first)]
    count = np.minimum(stop, np.r_[first[1:], edges]) - first
    s = span_hashes(wb, first, first + count + window - 1, BASE_B)
    head = np.cumsum(n) - n
    return low[first], s, row[first], first - head[row[first]], count


def first_of_equal(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mask of the rows whose (doc, at) is the smallest among rows of equal keys (all of them, if repeated)."""
    order = np.lexsort((at, doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        new[1:] = np.logical_or.reduce([k[a] != k[b] for k in keys])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    mask = np.empty(len(order), bool)
    mask[order] = (doc[order] == doc[lead]) & (at[order] == at[lead])
    return mask


def combined(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch; those that repeat within the batch lose their key and go to any partition."""
    first = first_of_equal((a, b), doc, at)
    spread = span_hashes(at, np.arange(len(at)), np.arange(len(at)) + 1)
    m = np.where(first, a, spread).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(m), pa.array(b.view(np.int64), mask=~first), pa.array(doc), pa.array(at)], names=["m", "s", "doc", "at"])


def segment_rows(docs: DataFrame, window: int, core: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            doc, tag = (np.asarray(column_array(batch, c)).astype(np.int64) for c in ("doc", "tag"))
            buf, offsets = text_buffer(column_array(batch, "text"))
            parts = []
            for lo, _, b, off in text_slices(buf, offsets):
                m, s, row, start, count = path_segments(b, off, window, core)
                parts.append((m, s, doc[lo + row], coordinate(tag[lo + row], start, count)))
            if parts:
                yield combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return docs.mapInArrow(run, SEGMENT_SCHEMA)


def edge_rows(wanted: DataFrame, window: int) -> DataFrame:
    """Single edges of the wanted segments ([doc, tag, text, open: array of coordinates])."""

    def run(batches):
        for batch in batches:
            lists = column_array(batch, "open").to_pylist()
            doc, tag = (np.asarray(column_array(batch, c)).astype(np.int64) for c in ("doc", "tag"))
            buf, offsets = text_buffer(column_array(batch, "text"))
            parts = []
            for lo, hi, b, off in text_slices(buf, offsets):
                asked = [(r - lo, x) for r in range(lo, hi) if lists[r] for x in lists[r]]
                if not asked:
                    continue
                starts, ends, n = word_spans(b, off)
                wa, wb = word_hashes(b, starts, ends, BASE_A), word_hashes(b, starts, ends, BASE_B)
                row = np.array([r for r, _ in asked])
                start, count = place_of(np.array([x for _, x in asked], np.int64))
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row, start = np.repeat(row, count), np.repeat(start, count) + inner
                begin = (np.cumsum(n) - n)[row] + start
                parts.append((span_hashes(wa, begin, begin + window, BASE_A), span_hashes(wb, begin, begin + window, BASE_B),
                              doc[lo + row], coordinate(tag[lo + row], start, np.ones_like(start))))
            if parts:
                yield combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return wanted.mapInArrow(run, SEGMENT_SCHEMA)


def not_first(rows: DataFrame):
    """[..., repeated, branches]: later occurrences of a key, and whether its minimizer has several keys."""
    same, near = Window.partitionBy("m", "s"), Window.partitionBy("m")
    return (rows.withColumn("lead", F.min(F.struct("doc", "at")).over(same))
            .withColumn("branches", F.min("s").over(near) != F.max("s").over(near))
            .select("doc", "at", (F.col("s").isNull() | (F.struct("doc", "at") != F.col("lead"))).alias("repeated"), "branches"))


def repeated_edges(docs: DataFrame, window: int, core: int) -> DataFrame:
    """[doc, tag, known]: coordinates of segments whose edges all start earlier elsewhere."""
    settled = (not_first(segment_rows(docs, window, core)).where("repeated OR branches")
               .groupBy("doc", tag_of("at").alias("tag"))
               .agg(F.collect_list(F.when(F.col("repeated"), F.col("at"))).alias("known"),
                    F.collect_list(F.when(~F.col("repeated"), F.col("at"))).alias("open")))
    return saved(settled, "repeated-segments")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", window: int = WINDOW, core: int = CORE) -> DataFrame:
    """[key, text: kept words joined by one space, n_words, n_removed, spans: removed [first, end) words]."""
    prepare(docs)
    if not 0 < core <= window or window - core >= 1 << COUNT_BITS:
        raise ValueError("core must lie in 1..window, and window - core below 128")
    whole = docs.select(F.col(key).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumn("tag", text_tag(F.coalesce("text", F.lit(""))))
    settled = repeated_edges(whole.where("doc IS NOT NULL"), window, core)
    wanted = whole.join(settled.where("size(open) > 0").select("doc", "tag", "open").hint("shuffle_hash"), ["doc", "tag"])
    single = not_first(edge_rows(wanted, window)).where("repeated").groupBy("doc", tag_of("at").alias("tag")).agg(F.collect_list("at").alias("known"))
    gone = (settled.select("doc", "tag", "known").unionAll(single).groupBy("doc", "tag").agg(F.flatten(F.collect_list("known")).alias("known")))
    joined = whole.join(gone.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "text", "known")
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches):
        for batch in batches:
            known = column_array(batch, "known").to_pylist()
            texts, words, removed, spans = [], [], [], []
            for text, marks in zip(column_array(batch, "text"), known, strict=True):
                w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                hit = np.zeros(0, np.int64)
                if marks:
                    start, count = place_of(np.array(marks, np.int64))
                    step = np.zeros(len(w) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + count + window - 1, -1)
                    cover = np.cumsum(step[:-1]) > 0
                    hit = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8))).reshape(-1, 2)
                    kept = list(itertools.compress(w, ~cover))
                else:
                    kept = w
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                words.append(len(w))
                removed.append(len(w) - len(kept))
                spans.append(hit.tolist())
            yield pa.RecordBatch.from_arrays([column_array(batch, "doc"), pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=schema.names)

    return joined.mapInArrow(run, schema)

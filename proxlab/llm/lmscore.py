"""Stupid-backoff language-model scores of documents (operator 10).

Each document is scored against all others: counts are those of the whole corpus less the document's own.
With c' such counts, N' the number of words elsewhere and ``alpha`` the back-off weight, a word costs

    S(w | context) = c'(context w) / c'(context)      if the n-gram occurs elsewhere
                     alpha * S(w | shorter context)   otherwise
    S(w)           = c'(w) / N'                       if the word occurs elsewhere
                     alpha / (N' + 1)                 otherwise

and a document's score is the mean of ln S over its words (their sum is returned too).  The first words
of a document have shorter contexts.

Relations: documents are dealt into blocks of about ``block_bytes`` of text.  A block explodes its
n-grams and pre-aggregates them, and sends its (n-gram, count) rows, packed per hash range, to the count
tables, which are partitioned by ranges of the n-gram hash.  A range adds the blocks' counts and joins the
totals back to the blocks in which the n-gram occurs, as a bit per n-gram that the block sent (set where
other blocks have it too) and the totals of those.  Each block then joins the totals to its n-grams and sums by document.  Work and memory per
task are bounded by block and range sizes, and a frequent n-gram is one row per block.

N-grams are compared by 64-bit hashes.  Words are runs of anything but blanks, tabs and line ends.  A null or
word-less text has no words, logprob 0 and a null score.  Every row is a document, repeated rows as well
(an exact copy counts as "elsewhere").  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, MASK, U64, column_array, prepare, saved, span_hashes, text_buffer, text_slices, word_hashes, word_spans

ORDER, ALPHA = 2, 0.4
BLOCK_BYTES, RANGE_BYTES = 12 << 20, 12 << 20
PACKED = "block long, part long, keys binary, counts binary"


def to_planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers as byte planes: the high planes of small numbers are zeros, which compress well."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys, as planes of their differences."""
    return to_planes(np.diff(keys, prepend=U64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=U64)


def grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order n, the hash of the n-gram that ends at each word (0 where the document has no n words before), and words per row."""
    buf, offsets = text_buffer(texts)
    hashes: list[list[np.ndarray]] = [[] for _ in range(order)]
    counts = []
    for _, _, b, off in text_slices(buf, offsets):
        starts, ends, n = word_spans(b, off)
        counts.append(n)
        w = word_hashes(b, starts, ends, BASE_A)
        place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        for k in range(order):
            h = np.zeros(len(w), U64)
            ok = np.flatnonzero(place >= k)
            h[ok] = np.maximum(span_hashes(w, ok - k, ok + 1, BASE_A + 2 * k), U64(1))
            hashes[k].append(h)
    return [np.concatenate(h) if h else np.zeros(0, U64) for h in hashes], np.concatenate(counts) if counts else np.zeros(0, np.int64)


def block_counts(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(hashes)
    keys, counts = np.unique(every[every != 0], return_counts=True)
    return keys, counts.astype(np.int64)


def own_counts(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each word's n-gram occurs in its own document."""
    order = np.lexsort((h, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order[1:]] != row[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group] if len(group) else 0
    return out


def document_sums(hashes: list[np.ndarray], n: np.ndarray, lookup, alpha: float) -> tuple[np.ndarray, ...]:
    """Per row: sum of ln S without the terms of N', words settled at each order, words that occur nowhere else."""
    order = len(hashes)
    row = np.repeat(np.arange(len(n)), n)
    elsewhere = [lookup(h) - own_counts(row, h) for h in hashes]
    log = np.zeros(len(row))
    open_ = np.ones(len(row), bool)
    settled = []
    for k in range(order - 1, -1, -1):
        there = open_ & (hashes[k] != 0)
        found = there & (elsewhere[k] > 0)
        value = np.log(elsewhere[k][found])
        if k:
            # the context is the (k)-gram that ends one word earlier; it occurs elsewhere if the n-gram does
            value -= np.log(elsewhere[k - 1][np.flatnonzero(found) - 1])
        log[found] += value
        settled.append(np.bincount(row[found], minlength=len(n)))
        open_ &= ~found
        log[there & open_] += np.log(alpha)
    return np.bincount(row, weights=log, minlength=len(n)), settled[::-1], np.bincount(row[open_], minlength=len(n))


def score(docs: DataFrame, key: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA,
          block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """[key, n_words, n_order1 .. n_order<order>, n_unseen, logprob, score]; n_order<k>: words settled by k-grams."""
    prepare(docs)
    whole = docs.select(F.col(key).alias("k"), F.col(text_col).alias("text"))
    size = whole.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = int(size // block_bytes) + 1
    n_ranges = int(size // range_bytes) + 1
    width = min(MASK, (1 << 64) // n_ranges + 1)
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("k", "text"), F.lit(n_blocks)))

    def range_cuts(keys: np.ndarray) -> np.ndarray:
        """Where each hash range begins in sorted keys."""
        return np.searchsorted((keys // U64(width)).astype(np.int64), np.arange(n_ranges + 1))

    def explode(table: pa.Table) -> pa.Table:
        hashes, _ = grams(table["text"].combine_chunks(), order)
        keys, counts = block_counts(hashes)
        cut = range_cuts(keys)
        rows = [(p, pack(keys[a:b]), counts[a:b].astype("<u4").tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int64()),
                         "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks = table["block"].to_pylist()
        keys = [unpack(x) for x in table["keys"].to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in table["counts"].to_pylist()]
        size = np.cumsum([0, *(len(x) for x in keys)])
        every, mine = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order_ = np.argsort(every, kind="stable")
        new = np.r_[True, every[order_[1:]] != every[order_[:-1]]]
        sums = np.add.reduceat(mine[order_], np.flatnonzero(new))
        summed = np.empty(len(every), np.int64)
        summed[order_] = sums[np.cumsum(new) - 1]
        out = []
        for i, b in enumerate(blocks):
            a, z = size[i], size[i + 1]
            back = summed[a:z] > mine[a:z]
            if back.any():
                out.append((b, table["part"][0].as_py(), np.packbits(back).tobytes(), to_planes(summed[a:z][back])))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(
            (("block", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())))})

    def join(docs_: pa.Table, totals: pa.Table) -> pa.Table:
        hashes, n = grams(docs_["text"].combine_chunks(), order)
        keys, counts = block_counts(hashes)
        cut = range_cuts(keys)
        for p, bits, c in zip(*(totals[n].to_pylist() for n in ("part", "keys", "counts")), strict=True):
            mine = counts[cut[p]:cut[p + 1]]
            mine[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)] = from_planes(c).astype(np.int64)

        def lookup(h: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(h), np.int64)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[at] == h, counts[at], 0)

        log, settled, unseen = document_sums(hashes, n, lookup, alpha)
        return pa.table({"k": docs_["k"], "n_words": pa.array(n, pa.int64()), "settled": pa.array(list(np.stack(settled, axis=1)), pa.list_(pa.int64())),
                         "n_unseen": pa.array(unseen, pa.int64()), "log": pa.array(log, pa.float64())})

    key_type = whole.schema["k"].dataType.simpleString()
    tables = dealt.groupBy("block").applyInArrow(explode, PACKED).groupBy("part").applyInArrow(total, PACKED)
    sums = (dealt.groupBy("block").cogroup(tables.groupBy("block"))
            .applyInArrow(join, f"k {key_type}, n_words long, settled array<long>, n_unseen long, log double"))
    sums = saved(sums, "lm-sums")
    words = sums.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    other = (F.lit(int(words)) - F.col("n_words")).cast("double")
    # words settled by unigrams divide by N', those that occur nowhere else by N' + 1
    flat = F.when(F.col("settled")[0] > 0, F.col("settled")[0] * F.log(other)).otherwise(0.0) + F.col("n_unseen") * F.log(other + 1)
    logprob = F.col("log") - flat
    return sums.select(F.col("k").alias(key), "n_words", *[F.col("settled")[i].alias(f"n_order{i + 1}") for i in range(order)], "n_unseen",
                       logprob.alias("logprob"), F.when(F.col("n_words") > 0, logprob / F.col("n_words")).alias("score"))

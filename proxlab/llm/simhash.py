"""SimHash near-duplicate detection over a forest of vantage-point trees (operator 3).

Fingerprints: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the document's
word shingles, repeats included.  Texts without a word have fingerprint 0 and are linked like any other.

Search: distinct fingerprints are dealt to shards by vantage-point trees.  Distances between the
fingerprints of unrelated texts crowd around 32 of 64 bits, so that a tree over whole fingerprints
prunes nothing at a radius of 4.  The forest therefore has one tree per segment of the bits: among
``segments`` segments, two fingerprints within ``max_bits`` differ by at most
``radius = max_bits // segments`` bits in one of them.  Each tree node holds a vantage point and a
median distance (both in its segment's Hamming metric, taken from a bounded sample of fingerprints, which
shapes the shards but never the result).  By the triangle bound a neighbour within ``radius`` of a
fingerprint at distance d lies at d - radius .. d + radius, so the fingerprint goes to its own side and,
if its ball crosses the boundary, to the outer side as well; all other branches are pruned.  Two
fingerprints within the radius thus always meet in a shard.  With more segments than bits the radius is
0 and no ball crosses a boundary: one copy per tree.

Shards over ``block`` fingerprints are cut into blocks by hash and every pair of blocks is a task's
input, so that no task holds more than two blocks however hot a shard is.  Inside, candidates are pruned
by the triangle bound to one more vantage point over all 64 bits and verified exactly; what leaves a
task is a spanning forest of its links, never the pairs.

Null texts count as empty.  Documents with a null id take part in no component: they get their
fingerprint and a null component_id.  Repeated rows are returned repeatedly with the same values.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_array, components, prepare, saved

SHINGLE_WORDS, MAX_BITS = 4, 4
SEED = 42
SAMPLE, LEAF, BLOCK = 8192, 4, 4096


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    line = b" ".join(w)
    starts = [0, *itertools.accumulate(len(x) + 1 for x in w)]
    digest = xxhash.xxh64_intdigest
    n = len(w) - words + 1
    h = np.fromiter((digest(line[a:b - 1], SEED) for a, b in zip(starts[:n], starts[words:], strict=False)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        bits = np.unpackbits(h[lo:lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` without its text and with ``out``, the fingerprint as a (signed) long.  One narrow pass."""
    prepare(docs)
    kept = [f for f in docs.schema.fields if f.name.lower() not in (text_col.lower(), out.lower())]
    schema = T.StructType([*kept, T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle_words) for t in column_array(batch, text_col)], np.uint64)
            yield pa.RecordBatch.from_arrays([column_array(batch, f.name) for f in kept] + [pa.array(fp.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def segment_masks(segments: int) -> list[int]:
    """64 bits dealt to ``segments`` neighbouring ranges of nearly equal width."""
    cut = [round(i * 64 / segments) for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cut)]


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage-point tree of one segment; leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf: int, seed: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.nodes: list[tuple] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.grow(np.unique(sample & self.mask), leaf)

    def grow(self, values: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        split = None
        if len(values) > leaf:
            # of a few random vantage points the one whose sphere halves the values best
            for point in self.rng.choice(values, min(8, len(values)), replace=False):
                d = distance(values, point)
                for median in range(int(d.min()), int(d.max())):
                    off = abs(int((d <= median).sum()) * 2 - len(values))
                    if split is None or off < split[0]:
                        split = (off, point, median, d <= median)
        if split is None:
            self.nodes[at] = ("leaf", self.leaves)
            self.leaves += 1
        else:
            _, point, median, near = split
            self.nodes[at] = (point, median, self.grow(values[near], leaf), self.grow(values[~near], leaf))
        return at

    def shards(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``fp``, leaf) of all leaves in which each fingerprint must be met."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(fp)))]
        seg = fp & self.mask
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            what = self.nodes[node]
            if what[0] == "leaf":
                rows.append(idx)
                leaves.append(np.full(len(idx), what[1]))
                continue
            point, median, inner, outer = what
            d = distance(seg[idx], point).astype(np.int64)
            todo += [(inner, idx[d <= median]), (outer, idx[d > median - self.radius])]
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(leaves) if leaves else np.zeros(0, np.int64)


class Forest:
    def __init__(self, sample: np.ndarray, max_bits: int, segments: int, leaf: int = LEAF):
        radius = max_bits // segments
        self.trees = [Tree(sample, m, radius, leaf, i) for i, m in enumerate(segment_masks(segments))]

    def shards(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, keys = zip(*(t.shards(fp) for t in self.trees), strict=True)
        return np.concatenate(rows), np.concatenate([k + (i << 40) for i, k in enumerate(keys)])


def spanning_links(fp: np.ndarray, side: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints; pairs within the same side of two are skipped.

    ``side`` is all 0 for a block against itself; 0 and 1 for two blocks.  Rows are ordered by distance
    to one vantage point, so each row meets only those whose distance differs by ``max_bits`` at most.
    """
    n = len(fp)
    d = distance(fp, fp[0]).astype(np.int64)
    order = np.argsort(d, kind="stable")
    fp, side, d = fp[order], side[order], d[order]
    two = bool(side.any())
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    upto = np.searchsorted(d, d + max_bits, side="right")
    links = []
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        end = int(upto[hi - 1])
        near = np.bitwise_count(fp[lo:hi, None] ^ fp[None, lo:end]) <= max_bits
        if two:
            near &= side[lo:hi, None] != side[None, lo:end]
        for i, j in np.argwhere(near).tolist():
            if j > i:
                a, b = find(lo + i), find(lo + j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((int(fp[lo + i]), int(fp[lo + j])))
    return links


def near_links(fps: DataFrame, col: str = "fp", max_bits: int = MAX_BITS, segments: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Links [a, b] whose closure equals that of all pairs of fingerprints within ``max_bits`` bits.

    ``sample`` bounds the fingerprints that shape the trees, ``block`` the rows of half a task's input.
    """
    prepare(fps)
    spark = fps.sparkSession
    distinct = saved(fps.select(F.col(col).alias("fp")).where("fp is not null").distinct(), "fingerprints")
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    if not len(some):
        return spark.createDataFrame([], "a long, b long")
    forest = spark.sparkContext.broadcast(Forest(some, max_bits, segments or max_bits + 1))

    def deal(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            row, key = forest.value.shards(fp)
            yield pa.RecordBatch.from_arrays([pa.array(fp[row].view(np.int64)), pa.array(key)], names=["fp", "shard"])

    # shard sizes decide the blocks: one row per leaf, and the leaves are bounded by the sample
    sizes = distinct.mapInArrow(deal, "fp long, shard long").groupBy("shard").count().where(F.col("count") > block)
    blocks = spark.sparkContext.broadcast({r["shard"]: -(-r["count"] // block) for r in sizes.collect()})

    def place(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            row, key = forest.value.shards(fp)
            cut = np.fromiter((blocks.value.get(k, 1) for k in key.tolist()), np.int64, len(key))
            mine = ((fp[row] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % cut
            out = []
            for part in [cut == 1, cut > 1]:
                f, k, c, m = fp[row][part], key[part], cut[part], mine[part]
                rep = np.repeat(np.arange(len(f)), c)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(c) - c, c)
                out.append((f[rep], k[rep], np.minimum(m[rep], other), np.maximum(m[rep], other), (m[rep] > other).astype(np.int64)))
            f, k, lo, hi, side = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(k), pa.array(lo), pa.array(hi), pa.array(side)],
                                             names=["fp", "shard", "lo", "hi", "side"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        links = spanning_links(fp, pdf["side"].to_numpy(np.int64), max_bits) if len(fp) > 1 else []
        return pd.DataFrame(np.array(links, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    placed = distinct.mapInArrow(place, "fp long, shard long, lo long, hi long, side long")
    return placed.groupBy("shard", "lo", "hi").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """[key, fp, component_id] for every row of ``docs``; component_id is the smallest key that links reach."""
    rows = saved(fingerprints(docs.select(F.col(key).alias("k"), F.col(text_col).alias("text")), shingle_words), "document-fingerprints")
    roots = components(near_links(rows.where("k is not null"), "fp", max_bits, segments), "a", "b")
    groups = (rows.where("k is not null").groupBy("fp").agg(F.min("k").alias("low"))
              .join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    lowest = groups.groupBy("root").agg(F.min("low").alias("component_id"))
    named = groups.join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    out = rows.join(named, F.col("fp") == F.col("of"), "left")
    return out.select(F.col("k").alias(key), "fp", F.when(F.col("k").isNotNull(), F.col("component_id")).alias("component_id"))

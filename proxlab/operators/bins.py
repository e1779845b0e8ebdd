"""Sparse feature rows and their bins for histogram boosting.

* :func:`entries` reads the non-zero entries of ml vectors (sparse or dense) or arrays from Arrow batches; no row is
  ever made dense, so a one-hot column of any number of categories costs one entry a row.
* :func:`edges` finds each feature's bin edges from a mergeable weighted quantile summary, an aggregation with a
  proven error.
* :func:`bundle_starts` packs mutually exclusive neighbouring features (the columns of a one-hot group) into one bundle,
  so that a row is one number per bundle.
* :class:`FeatureBins` numbers all (feature, bin) pairs; the bin of a feature's absent entries (zero, or missing) has no
  number in a row: its sums follow by difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: points of a summary: every prune moves at most 1 / SUMMARY of a feature's weight past any value
SUMMARY = 4096
#: points that a task holds until it summarizes them
CHUNK_POINTS = 1 << 20
#: entries after which a task puts equal ones together
MERGE_ENTRIES = 1 << 18
#: points of a feature that one task orders in the end
FINAL_POINTS = 1 << 19
POINTS = "feat int, value double, weight double, prunes int"


def entries(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the non-zero entries, rows and features ascending; missing values are NaN.

    ``col`` holds ml vectors (as their storage struct) or lists; null rows and rows of another width are errors.
    """
    if col.null_count:
        raise ValueError("some rows have no feature vector")
    if pa.types.is_struct(col.type):
        dense = np.asarray(col.field("type")) == 1
        values = col.field("values")
        width = np.where(dense, np.asarray(pc.fill_null(pc.list_value_length(values), 0)), np.asarray(pc.fill_null(col.field("size"), 0)))
        indices = col.field("indices").flatten().to_numpy(zero_copy_only=False)
    else:
        dense, values = np.ones(len(col), bool), col
        width, indices = np.asarray(col.value_lengths()), np.zeros(0, np.int32)
    if (width != n).any():
        raise ValueError(f"some rows have no feature vector of {n} numbers")
    size = np.asarray(pc.fill_null(pc.list_value_length(values), 0)).astype(np.int64)
    value = pc.fill_null(values.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    feat = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    feat[~dense[row]] = indices
    some = value != 0.0
    return row[some], feat[some], value[some]


def width(df: DataFrame, features: str) -> int:
    """Number of features, from one row; a vector column without rows is an error."""
    def run(batches):
        for b in batches:
            for v in b.column(0):
                x = v.as_py()
                if x is not None:
                    n = len(x) if isinstance(x, list) else (x["size"] if x["type"] == 0 else len(x["values"]))
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
                    return

    first = df.select(features).limit(1).mapInArrow(run, "n long").first()
    if first is None:
        raise ValueError("empty training data")
    return int(first["n"])


# ---------------------------------------------------------------- weighted quantile summary

def combined(feat: np.ndarray, value: np.ndarray, weight: np.ndarray, prunes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Points sorted by feature and value, equal ones put together."""
    order = np.lexsort((value, feat))
    feat, value, weight, prunes = feat[order], value[order], weight[order], prunes[order]
    new = np.ones(len(feat), bool)
    new[1:] = (feat[1:] != feat[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    weight, prunes = (np.add.reduceat(weight, first), np.maximum.reduceat(prunes, first)) if len(first) else (weight[:0], prunes[:0])
    return feat[first], value[first], weight, prunes


def compressed(feat: np.ndarray, value: np.ndarray, weight: np.ndarray, prunes: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Points sorted by feature and value, equal ones combined; features of over 4 ``size`` points are pruned.

    A prune cuts a feature's ordered points into groups of at most W / size weight (a heavier point is a group by
    itself) and keeps the largest value of each with the group's weight.  So the weight up to any value changes by
    less than W / size per prune, and by at most (prunes) W / size in all.
    """
    feat, value, weight, prunes = combined(feat, value, weight, prunes)
    ids, at, count = np.unique(feat, return_index=True, return_counts=True)
    if not (count > 4 * size).any():
        return feat, value, weight, prunes
    keep = np.ones(len(feat), bool)
    for lo, k in zip(at[count > 4 * size].tolist(), count[count > 4 * size].tolist(), strict=True):
        w = weight[lo:lo + k]
        limit = w.sum() / size
        heavy = w >= limit
        light = np.cumsum(np.where(heavy, 0.0, w))
        # the light points after each whole ``limit`` of light weight, and every heavy one, end a group
        group = np.floor(light / limit).astype(np.int64)
        last = np.r_[(group[1:] != group[:-1]) | heavy[1:] | heavy[:-1], True]
        end = np.flatnonzero(last)
        keep[lo:lo + k] = last
        weight[lo + end] = np.add.reduceat(w, np.r_[0, end[:-1] + 1])
        prunes[lo:lo + k] = prunes[lo:lo + k].max() + 1
    return feat[keep], value[keep], weight[keep], prunes[keep]


def _point_batch(points: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    f, v, w, p = points
    return pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(v), pa.array(w), pa.array(p.astype(np.int32))], names=["feat", "value", "weight", "prunes"])


def summary(rows: DataFrame, features: str, n: int, weight: str | None = None, size: int = SUMMARY) -> DataFrame:
    """Points [feat, value, weight, prunes] of all non-zero, non-missing entries; one narrow pass.

    A task puts equal entries together every ``MERGE_ENTRIES``, prunes each chunk of ``CHUNK_POINTS`` different ones once
    and merges equally often merged summaries (a binary counter), so that ``prunes`` grows with the logarithm of its chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: list[tuple | None] = []  # at level i: a summary of 2^i chunks
        buffer, held = [], 0             # entries as they come
        chunk, points = [], 0            # and put together

        def push(part: tuple) -> None:
            level = 0
            while level < len(merged) and merged[level] is not None:
                part = compressed(*(np.concatenate(x) for x in zip(merged[level], part, strict=True)), size)
                merged[level] = None
                level += 1
            merged.extend([None] * (level + 1 - len(merged)))
            merged[level] = part

        def merge() -> None:
            nonlocal held, points
            if buffer:
                chunk.append(combined(*(np.concatenate(x) for x in zip(*buffer, strict=True))))
                points += len(chunk[-1][0])
            buffer.clear()
            held = 0

        def close() -> None:
            nonlocal points
            if chunk:
                parts = [np.concatenate(x) for x in zip(*chunk, strict=True)]
                chunk.clear()
                push(compressed(*parts, size))
            points = 0

        for b in batches:
            row, feat, value = entries(b.column(0), n)
            w = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[row] if weight else np.ones(len(row))
            good = ~np.isnan(value)
            buffer.append((feat[good].astype(np.int32), value[good], w[good], np.zeros(int(good.sum()), np.int32)))
            held += len(row)
            if held >= MERGE_ENTRIES:
                merge()
                if points >= CHUNK_POINTS:
                    close()
        merge()
        close()
        for part in merged:
            if part is not None and len(part[0]):
                yield _point_batch(part)

    return rows.select(features, *([weight] if weight else [])).mapInArrow(run, POINTS)


def edges(rows: DataFrame, features: str, n: int, max_bins: int, zero_missing: bool = False, weight: str | None = None, size: int = SUMMARY,
          final_points: int = FINAL_POINTS) -> DataFrame:
    """[feat, edges: array<double>, weight, prunes] of the features that have a value.

    A feature of fewer than ``max_bins`` distinct values gets them all as edges (bins are exact), another the smallest
    values with at least i / ``max_bins`` of the weight up to them, i = 1 .. max_bins - 1; what the weight up to an edge
    is off by is at most prunes / ``size`` of the whole.  Zeros, unless missing, enter by difference.
    """
    points = summary(rows, features, n, weight, size)
    equal = ["feat", "value"]
    points = points.groupBy(*equal).agg(F.sum("weight").alias("weight"), F.max("prunes").alias("prunes"))
    if not zero_missing:
        # all weight less that of the entries, missing ones included
        whole = rows.agg(F.sum(weight) if weight else F.count("*").cast("double")).first()[0] or 0.0
        absent = points.groupBy("feat").agg(F.sum("weight").alias("w")).join(missing_weight(rows, features, n, weight), "feat", "full")
        every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("feat")).join(absent, "feat", "left")
        left = F.lit(float(whole)) - F.coalesce("w", F.lit(0.0)) - F.coalesce("missing", F.lit(0.0))
        # weights are sums of doubles: what is left by rounding is no zero
        zeros = every.select("feat", F.lit(0.0).alias("value"), left.alias("weight"), F.lit(0).alias("prunes")).where(F.col("weight") > float(whole) * 1e-9)
        points = points.unionByName(zeros)
    points = points.persist()
    count = points.groupBy("feat").agg(F.count("*").alias("k"))
    while (most := count.agg(F.max("k")).first()[0] or 0) > final_points:
        # any division of a feature's points may be pruned part by part: parts of a bounded number of points
        big = points.join(count.where(F.col("k") > final_points), "feat")
        part = F.pmod(F.xxhash64("value"), F.ceil(F.col("k") / final_points * 2))
        pruned = big.withColumn("part", part).groupBy("feat", "part").applyInArrow(
            lambda t: pa.Table.from_batches([_point_batch(compressed(*(t[c].to_numpy() for c in ("feat", "value", "weight", "prunes")), size))]), POINTS)
        small = points.join(count.where(F.col("k") <= final_points).select("feat"), "feat", "left_semi")
        old, points = points, small.unionByName(pruned).persist()
        count = points.groupBy("feat").agg(F.count("*").alias("k"))
        if (count.agg(F.max("k")).first()[0] or 0) >= most:
            raise ValueError("the summary does not shrink: final_points must exceed 8 times size")
        old.unpersist()
    upto = Window.partitionBy("feat").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole_of = Window.partitionBy("feat")
    cum = (points.withColumn("upto", F.sum("weight").over(upto)).withColumn("total", F.sum("weight").over(whole_of))
           .withColumn("k", F.count("*").over(whole_of)))
    rank = lambda w: F.floor(w * max_bins / F.col("total") + 1e-9)
    is_edge = (F.col("k") < max_bins) | ((rank(F.col("upto")) > rank(F.col("upto") - F.col("weight"))) & (rank(F.col("upto") - F.col("weight")) < max_bins - 1))
    return cum.groupBy("feat").agg(F.array_sort(F.collect_list(F.when(is_edge, F.col("value")))).alias("edges"), F.max("total").alias("weight"), F.max("prunes").alias("prunes"))


def missing_weight(rows: DataFrame, features: str, n: int, weight: str | None) -> DataFrame:
    """[feat, missing]: weight of the missing (NaN or null) entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for b in batches:
            row, feat, value = entries(b.column(0), n)
            gone = np.isnan(value)
            w = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[row[gone]] if weight else None
            total += np.bincount(feat[gone], w, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feat", "w"])

    parts = rows.select(features, *([weight] if weight else [])).mapInArrow(run, "feat int, w double")
    return parts.groupBy("feat").agg(F.sum("w").alias("missing"))


# ---------------------------------------------------------------- bundles of exclusive features

def bundle_starts(rows: DataFrame, features: str, n: int) -> np.ndarray:
    """First feature of each bundle: the fewest runs of neighbouring features of which no row holds two entries.

    Within a row only neighbouring entries matter; for each feature the nearest next entry over all rows decides
    (one number a feature), and a run ends before it first reaches such a next entry.
    """
    if n == 1:
        return np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.full(n, n, np.int64)
        for b in batches:
            row, feat, _ = entries(b.column(0), n)
            pair = row[1:] == row[:-1]
            np.minimum.at(near, feat[:-1][pair], feat[1:][pair])
        at = np.flatnonzero(near < n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(near[at].astype(np.int32))], names=["feat", "next"])

    near = np.full(n, n, np.int64)
    for r in rows.select(features).mapInArrow(run, "feat int, next int").groupBy("feat").agg(F.min("next").alias("next")).collect():
        near[r["feat"]] = r["next"]
    starts, end = [0], int(near[0])
    for f in range(1, n):
        if f >= end:
            starts.append(f)
            end = n
        end = min(end, int(near[f]))
    return np.array(starts, np.int64)


class Edges:
    """The edges of every feature, ascending, in one array: a feature costs two numbers, not an object."""

    def __init__(self, values: np.ndarray, start: np.ndarray):
        self.values, self.start = values, start

    @classmethod
    def of(cls, edges) -> Edges:
        return cls(np.concatenate([np.zeros(0), *edges]).astype(np.float64), np.cumsum([0, *map(len, edges)]))

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, feature: int) -> np.ndarray:
        if not 0 <= feature < len(self):
            raise IndexError(feature)
        return self.values[self.start[feature]:self.start[feature + 1]]

    def below(self, feat: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Number of the feature's edges below each value, by bisection of all at once."""
        lo, hi = self.start[feat], self.start[feat + 1]
        first, live = lo.copy(), np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.values[mid] < value[live]
            lo[live[less]], hi[live[~less]] = mid[less] + 1, mid[~less]
            live = live[lo[live] < hi[live]]
        return lo - first


@dataclass(frozen=True)
class FeatureBins:
    """Edges and numbering of all bins.  Bin 0 of a feature is missing, bin b holds values in (edges[b-2], edges[b-1]].

    The code of (feature, bin) is start[feature] + bin.  ``default`` is the bin of a feature's absent entries.
    """
    edges: Edges         # per feature, ascending
    start: np.ndarray    # first code of each feature, and the number of codes
    default: np.ndarray
    bundle: np.ndarray   # of each feature
    zero_missing: bool

    @property
    def codes(self) -> int:
        return int(self.start[-1])

    @property
    def n(self) -> int:
        return len(self.edges)

    @property
    def width(self) -> int:
        return int(self.bundle[-1]) + 1

    @classmethod
    def of(cls, edges: Edges | list[np.ndarray], bundles: np.ndarray, zero_missing: bool) -> FeatureBins:
        edges = edges if isinstance(edges, Edges) else Edges.of(edges)
        n = len(edges)
        size = np.diff(edges.start) + 2
        if size.sum() >= 1 << 31:
            raise ValueError("more than 2^31 bins in all")
        default = np.zeros(n, np.int64) if zero_missing else edges.below(np.arange(n), np.zeros(n)) + 1
        bundle = np.searchsorted(bundles, np.arange(n), side="right") - 1
        return cls(edges, np.r_[0, np.cumsum(size)], default, bundle, zero_missing)

    def rows(self, col: pa.Array) -> np.ndarray:
        """Per row and bundle the code of its entry plus 1, or 0 where all features of the bundle are at their default."""
        row, feat, value = entries(col, self.n)
        out = np.zeros((len(col), self.width), np.int32)
        missing = np.isnan(value)
        place = self.edges.below(feat, value) + 1
        place[missing] = 0
        other = place != self.default[feat]
        row, feat, place = row[other], feat[other], place[other]
        out[row, self.bundle[feat]] = self.start[feat] + place + 1
        return out


def find_bins(rows: DataFrame, features: str, max_bins: int, zero_missing: bool) -> FeatureBins:
    """Edges and bundles of [features] from three narrow passes and small aggregations."""
    n = width(rows, features)
    found = edges(rows, features, n, max_bins, zero_missing).select("feat", "edges").toArrow().sort_by("feat").combine_chunks()
    size = np.zeros(n + 1, np.int64)
    if found.num_rows:
        size[found["feat"].to_numpy() + 1] = pc.list_value_length(found["edges"]).to_numpy()
        values = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in found["edges"].chunks])
    else:
        values = np.zeros(0)
    return FeatureBins.of(Edges(values, np.cumsum(size)), bundle_starts(rows, features, n), zero_missing)

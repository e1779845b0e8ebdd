"""Gradient-boosted variance trees (T3, T8): the trees of pyspark.ml's GBTClassifier and GBTRegressor, for all folds and grid points at once.

``pyspark.ml`` fits each fold and grid point by itself, with a job per level of a tree and one per round.  Here all of
them grow in common passes:

* every fold has its own thresholds, found as ``pyspark.ml`` finds them from the rows that the fold's models learn from
  (all of up to max(maxBins^2, 10000) rows, a random sample of about so many of more rows).  Every row is binned once for
  each fold.  Binary columns of which no row holds two form one bundle: a row has one code in it;
* the state is a block of rows of one fold: codes, labels and each model's margins.  A round's trees are added to the margins
  in the pass that builds the next round's first sums; every ``CUT_ROUNDS`` rounds the state becomes a reliable checkpoint;
* a pass (one job) finds each row's node in the growing trees and sums count and residual by (model, node,
  code), of a large node's smaller child only: the other's are the parent's less it.  The driver picks the splits from these sums, at
  most ``MOST_CELLS`` of them;
* a split maximizes the loss of variance; of equal ones the smaller feature, then the smaller threshold counts.  The first
  tree fits the labels and weighs 1, later ones fit the residuals of the loss and weigh ``stepSize``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package
from .bins import bundle_starts, entries, width
from .boost import NODE, HistBoostModel, _node_table
from .coded import BLOCK_ROWS, GROUP_CODES, Groups, Leaves, add_up, dealt, groups_for, leaf_masks
from .linalg import DIRECT_COLLECT_MAX

CUT_ROUNDS = 20
#: rows of a node up to which both children are summed: in small nodes many splits gain the same but for rounding
EXACT_ROWS = 1 << 12
#: sums that the driver holds for the nodes of a level, of all models
MOST_CELLS = 1 << 22
#: rows that thresholds are found from, or maxBins squared if that is more
LEAST_SAMPLE = 10_000


def binary_features(data: DataFrame, n: int) -> np.ndarray | None:
    """Which features the column's attributes call binary; None if some are nominal."""
    attrs = data.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    out = np.zeros(n, bool)
    out[[a["idx"] for a in attrs.get("binary", [])]] = True
    return None if attrs.get("nominal") else out


def served(points: list) -> bool:
    """Whether the estimators ask for nothing but what is done here."""
    def plain(p) -> bool:
        if not isinstance(p, (GBTClassifier, GBTRegressor)) or p.getOrDefault("lossType") not in ("logistic", "squared"):
            return False
        if any(p.isSet(x) for x in ("weightCol", "validationIndicatorCol", "thresholds") if p.hasParam(x)) or p.getOrDefault("leafCol"):
            return False
        return (p.getOrDefault("subsamplingRate") == 1.0 and p.getOrDefault("minWeightFractionPerNode") == 0.0
                and p.getOrDefault("featureSubsetStrategy") in ("all", "auto"))

    return all(map(plain, points)) and len({(type(p), p.getOrDefault("maxBins")) for p in points}) == 1


# ---------------------------------------------------------------- bins

def midpoints(value: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between distinct values (ascending, with their counts): all midpoints if they are no more, else
    those nearest to equal shares of the rows."""
    between = (value[:-1] + value[1:]) / 2.0
    if len(between) <= most:
        return between
    stride = count.sum() / (most + 1)
    upto, target, out = np.cumsum(count), stride, []
    for i in range(len(between)):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(between[i])
            target += stride
    return np.array(out)


def thresholds(rows: DataFrame, n: int, binary: np.ndarray, count: int, max_bins: int) -> list[np.ndarray]:
    """Thresholds of each feature of [features]; binary ones have none."""
    need = max(max_bins * max_bins, LEAST_SAMPLE)
    some = rows.select("features") if count <= need else rows.select("features").sample(need / count, seed=17)

    def run(batches):
        for b in batches:
            _, feat, value = entries(b.column(0), n)
            mine = ~binary[feat]
            # an entry for the row itself, to count the zeros
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[feat[mine], np.full(b.num_rows, -1)].astype(np.int32)),
                                              pa.array(np.r_[value[mine], np.zeros(b.num_rows)])], names=["feat", "value"])

    found = some.mapInArrow(run, "feat int, value double").groupBy("feat", "value").count().toArrow().sort_by([("feat", "ascending"), ("value", "ascending")])
    feat, value, number = (found[c].to_numpy() for c in ("feat", "value", "count"))
    sampled, out = number[feat == -1].sum(), []
    for f in range(n):
        v, c = value[feat == f], number[feat == f]
        zeros = sampled - c.sum()
        if zeros > 0:
            at = np.searchsorted(v, 0.0)
            v, c = np.insert(v, at, 0.0), np.insert(c, at, zeros)
        out.append(midpoints(v, c, min(max_bins, count) - 1) if not binary[f] and len(v) > 1 else np.zeros(0))
    return out


class Bins:
    """Codes of all folds' thresholds.  A bundle's codes are ``offset[bundle]`` and up: a bin of its one feature, or 0 where no binary
    feature of it is 1, else the number of the one that is."""

    def __init__(self, cuts: list[list[np.ndarray]], binary: np.ndarray, starts: np.ndarray):
        self.cuts, self.binary, self.n = cuts, binary, len(binary)
        starts = np.unique(np.r_[starts, np.flatnonzero(~binary), np.flatnonzero(~binary) + 1])
        starts = starts[starts < self.n]
        self.bundle = np.searchsorted(starts, np.arange(self.n), side="right") - 1
        self.place = np.arange(self.n) - starts[self.bundle] + 1
        size = np.zeros(len(starts), np.int64)
        np.maximum.at(size, self.bundle, np.where(binary, self.place + 1, [max(len(c[f]) + 1 for c in cuts) for f in range(self.n)]))
        self.offset = np.r_[0, np.cumsum(size)]
        self.width, self.codes = len(starts), int(self.offset[-1])
        self.kind = np.uint8 if self.codes <= 1 << 8 else np.uint16 if self.codes <= 1 << 16 else np.int32
        self.candidates = [self._candidates(c) for c in cuts]

    def _candidates(self, cuts: list[np.ndarray]) -> dict[str, np.ndarray]:
        """All splits by feature, then threshold: code (the last to go left; of a binary feature the one to go right) and threshold."""
        many = [1 if self.binary[f] else len(cuts[f]) for f in range(self.n)]
        feat = np.repeat(np.arange(self.n), many)
        nth = np.arange(len(feat)) - np.repeat(np.cumsum(many) - many, many)
        return {"feature": feat, "code": self.offset[self.bundle[feat]] + np.where(self.binary[feat], self.place[feat], nth), "binary": self.binary[feat],
                "thr": np.concatenate([np.zeros(0), *([0.5] if self.binary[f] else cuts[f] for f in range(self.n))])}

    def rows(self, col: pa.Array) -> np.ndarray:
        """[fold, bundle, row]."""
        row, feat, value = entries(col, self.n)
        out = np.empty((len(self.cuts), self.width, len(col)), self.kind)
        out[:] = self.offset[:-1, None]
        one = self.binary[feat]
        if (value[one] != 1.0).any():
            raise ValueError("binary features must be 0 or 1")
        out[:, self.bundle[feat[one]], row[one]] = self.offset[self.bundle[feat[one]]] + self.place[feat[one]]
        for f in np.flatnonzero(~self.binary):
            x, mine = np.zeros(len(col)), feat == f
            x[row[mine]] = value[mine]
            for s, cuts in enumerate(self.cuts):
                out[s, self.bundle[f]] = self.offset[self.bundle[f]] + np.searchsorted(cuts[f], x)
        return out


# ---------------------------------------------------------------- trees

@dataclass
class Spec:
    """One model: its grid point, and the fold whose rows it must not learn from (the number of folds: it learns from all)."""
    depth: int
    rounds: int
    step: float
    min_rows: int
    min_gain: float
    fold: int
    trees: list = field(default_factory=list)


class Tree:
    """A tree while it grows, level by level; ``cells`` are [count, sum] by code of the leaves that may split."""

    def __init__(self, spec: Spec, bins: Bins, signs: bool):
        self.spec, self.bins, self.cand, self.signs = spec, bins, bins.candidates[spec.fold], signs
        self.nodes = {k: [v] for k, v in NODE.items()} | {"code": [0]}
        self.cells: dict[int, np.ndarray] = {}
        self.pairs: dict[int, tuple[int, int]] = {}     # smaller child -> (larger child, parent)

    def take(self, nodes: list[int], sums: np.ndarray) -> list[int]:
        """The asked nodes' sums; returns the nodes to ask for next."""
        known = {}
        for node, own in zip(nodes, sums, strict=True):
            known[node] = own
            if node in self.pairs:
                other, parent = self.pairs[node]
                rest = self.cells[parent] - own
                rest[1, rest[0] == 0] = 0.0
                known[other] = rest
        self.cells, self.pairs = known, {}
        at = sorted(known)
        cells = np.stack([known[x] for x in at])
        total = cells[:, :, :self.bins.offset[1]].sum(axis=2)
        if 0 in known:
            self.nodes["value"][0] = total[0, 1] / max(1.0, total[0, 0])
        if self.nodes["depth"][at[0]] >= self.spec.depth or not len(self.cand["code"]):
            return []
        return self._split(at, cells, total)

    def _split(self, at: list[int], cells: np.ndarray, total: np.ndarray) -> list[int]:
        c = self.cand
        upto = np.concatenate([np.cumsum(cells[:, :, a:b], axis=2) for a, b in zip(self.bins.offset[:-1], self.bins.offset[1:])], axis=2)
        left = np.where(c["binary"], total[:, :, None] - cells[:, :, c["code"]], upto[:, :, c["code"]])
        right = total[:, :, None] - left
        (n0, s0), (n1, s1), (n, s) = left.swapaxes(0, 1), right.swapaxes(0, 1), total.T[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = s0 * s0 / n0 + s1 * s1 / n1
            gain = (parts - s * s / n) / n
            if self.signs:
                # labels -1 and 1: squares sum to the count, and many splits gain the same; as pyspark.ml adds up, its choice among them
                low = c["binary"] & (s1 * n0 < s0 * n1)
                a, b = (((n0 - s0 * s0 / n0) / n0, n0), ((n1 - s1 * s1 / n1) / n1, n1))
                a, b = [np.where(low, y, x) for x, y in zip(a, b)], [np.where(low, x, y) for x, y in zip(a, b)]
                gain = (n - s * s / n) / n - a[1] / n * a[0] - b[1] / n * b[0]
            # a difference that rounding makes is none
            ok = (n0 >= self.spec.min_rows) & (n1 >= self.spec.min_rows) & (gain >= self.spec.min_gain) & (gain * n > 1e-14 * parts)
        gain = np.where(ok, gain, -np.inf)
        best, asked = gain.argmax(axis=1), []
        for i, node in enumerate(at):
            b = best[i]
            if gain[i, b] > 0:
                asked += self._children(node, int(b), [(n0[i, b], s0[i, b]), (n1[i, b], s1[i, b])])
        return asked

    def _children(self, node: int, b: int, sides: list[tuple]) -> list[int]:
        t, first = self.nodes, len(self.nodes["feature"])
        for key, v in (("feature", int(self.cand["feature"][b])), ("code", int(self.cand["code"][b])), ("thr", float(self.cand["thr"][b])),
                       ("left", first), ("right", first + 1), ("default_left", False)):
            t[key][node] = v
        depth = t["depth"][node] + 1
        for number, total in sides:
            for key, v in {**NODE, "code": 0, "depth": depth, "value": float(total / number)}.items():
                t[key].append(v)
        if depth >= self.spec.depth:
            return []
        if sides[0][0] + sides[1][0] < EXACT_ROWS:
            return [first, first + 1]
        small, large = (first, first + 1) if sides[0][0] <= sides[1][0] else (first + 1, first)
        self.pairs[small] = large, node
        return [small]

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(self.nodes[k]) for k in ("feature", "code", "left", "right", "value", "depth")}


class Path:
    """A tree over coded rows: of each node the bundle to look at and, by code, the node that follows (a leaf follows itself)."""

    def __init__(self, t: dict[str, np.ndarray], offset: np.ndarray, bundle: np.ndarray, binary: np.ndarray):
        nodes, codes = len(t["feature"]), int(offset[-1])
        inner, f = t["feature"] >= 0, np.maximum(t["feature"], 0)
        code = np.arange(codes)
        goes_left = np.where(binary[f][:, None], code != t["code"][:, None], code <= t["code"][:, None])
        follows = np.where(goes_left, t["left"][:, None], t["right"][:, None])
        self.next = np.where(inner[:, None], follows, np.arange(nodes)[:, None]).astype(np.int32)
        self.bundle, self.codes, self.depth = np.where(inner, bundle[f], 0), codes, int(t["depth"].max())

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of [bundle, row]."""
        rows = codes.shape[1]
        if not self.depth:
            return np.zeros(rows, np.intp)
        at, flat, follow, start = np.arange(rows), codes.ravel(), self.next.ravel(), self.bundle * rows
        node = self.next[0].take(codes[self.bundle[0]])
        for _ in range(self.depth - 1):
            place = start.take(node)
            place += at
            place = flat.take(place) + np.multiply(node, self.codes, dtype=np.intp)
            node = follow.take(place)
        return node


# ---------------------------------------------------------------- the fit

def residual(logistic: bool, first: bool, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """What the next tree fits: the labels, then the loss's negative gradient."""
    if first:
        return y
    if not logistic:
        return 2.0 * (y - margin)
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


class Fit:
    """All models of ``specs``, grown together over one state: an RDD of blocks (fold, codes [fold, bundle, row], label, margins
    [model, row]).  It is no DataFrame, as the plan of one would hold all rounds since the last checkpoint."""

    def __init__(self, data: DataFrame, bins: Bins, specs: list[Spec], logistic: bool, rows: int):
        self.spark, self.bins, self.specs, self.logistic = data.sparkSession, bins, specs, logistic
        self.state = self._coded(data, rows).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None
        self.partitions = self.state.getNumPartitions()

    def _coded(self, data: DataFrame, rows: int) -> RDD:
        shared, shape, models, logistic = self.spark.sparkContext.broadcast(self.bins), (len(self.bins.cuts), self.bins.width), len(self.specs), self.logistic

        def run(batches):
            held: dict[int, list] = {}

            def block(fold: int) -> pa.RecordBatch:
                codes, label = zip(*held.pop(fold), strict=True)
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(codes, axis=2), np.concatenate(label))]
                return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), *raw], names=["fold", "codes", "label"])

            for b in batches:
                codes, label, folds = shared.value.rows(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
                for fold in np.unique(folds).tolist():
                    held.setdefault(fold, []).append((codes[:, :, folds == fold], label[folds == fold]))
                    if sum(len(y) for _, y in held[fold]) >= BLOCK_ROWS:
                        yield block(fold)
            for fold in list(held):
                yield block(fold)

        def unpacked(r):
            y = np.frombuffer(r["label"])
            return r["fold"], np.frombuffer(r["codes"], shared.value.kind).reshape(*shape, -1), 2.0 * y - 1.0 if logistic else y, np.zeros((models, len(y)))

        blocks = data.select("features", "label", "fold").mapInArrow(run, "fold int, codes binary, label binary")
        return dealt(blocks, rows, np.dtype(self.bins.kind).itemsize * shape[0] * shape[1] + 8 * (1 + models)).rdd.map(unpacked)

    def finders(self, trees: dict[int, Tree]):
        """(a function that makes (model, its fold, leaf values, leaf of each row of its codes and their numbers, or None where the root
        is one) of the trees, for the tasks, the groups whose numbers that takes)."""
        offset, bundle, binary, sizes = self.bins.offset, self.bins.bundle, self.bins.binary, np.diff(self.bins.offset)
        groups, parts = Groups(sizes, GROUP_CODES, offset[:-1]), []
        for m, tree in trees.items():
            t = tree.arrays()
            inner, of = t["feature"] >= 0, bundle[np.maximum(t["feature"], 0)]

            def goes_left(nodes, b, t=t):
                code, last = np.arange(offset[b], offset[b + 1]), t["code"][nodes][:, None]
                return np.where(binary[t["feature"][nodes]][:, None], code != last, code <= last)

            bits = leaf_masks(np.where(inner, t["left"], -1), t["right"], of, goes_left) if inner[0] and Leaves.served(int(inner.sum()) + 1, groups) else None
            parts.append((m, self.specs[m].fold, t, bits))

        def make():
            out = []
            for m, fold, t, bits in parts:
                find = None
                if bits is not None:
                    find = lambda rows, numbers, x=Leaves(*bits, groups): x.node.take(x.places(numbers))
                elif t["feature"][0] >= 0:
                    find = lambda rows, numbers, x=Path(t, offset, bundle, binary): x.leaves(rows)
                out.append((m, fold, t["value"], find))
            return out

        return make, groups

    def add_trees(self, trees: dict[int, Tree], weight: dict[int, float], cut: bool) -> None:
        """The state with one more tree per model; it is built by the next pass over it."""
        make, groups = self.finders(trees)

        def run(blocks):
            made = make()
            for fold, codes, label, margins in blocks:
                margins = margins.copy()
                numbers = {own: groups.numbers(codes[own]) for own in {x[1] for x in made}}
                for m, own, value, leaf in made:
                    margins[m] += weight[m] * (value[0] if leaf is None else value.take(leaf(codes[own], numbers[own])))
                yield fold, codes, label, margins

        if self.before is not None:
            self.before.unpersist()
        self.before, self.state = self.state, self.state.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)
        if cut:
            checkpoint_dir(self.spark)
            self.state.checkpoint()

    def close(self) -> None:
        for rows in (self.before, self.state):
            if rows is not None:
                rows.unpersist()

    def run(self) -> None:
        last = max(s.rounds for s in self.specs)
        for r in range(last):
            trees = {m: Tree(s, self.bins, self.logistic and r == 0) for m, s in enumerate(self.specs) if r < s.rounds}
            asked = {m: [0] for m in trees}
            while asked:
                sums, at = self._sums(trees, asked, r == 0), 0
                for m, nodes in list(asked.items()):
                    asked[m] = trees[m].take(nodes, sums[at:at + len(nodes)])
                    at += len(nodes)
                asked = {m: nodes for m, nodes in asked.items() if nodes}
            weight = {m: 1.0 if r == 0 else self.specs[m].step for m in trees}
            for m, t in trees.items():
                scale = weight[m] * (2.0 if self.logistic else 1.0)     # the probability is that of twice the margin
                self.specs[m].trees.append({**t.nodes, "value": [scale * v for v in t.nodes["value"]]})
            self.add_trees(trees, weight, cut=(r + 1) % CUT_ROUNDS == 0 and r + 1 < last)

    def _sums(self, trees: dict[int, Tree], asked: dict[int, list[int]], first: bool) -> np.ndarray:
        """[node asked for, (count, sum), code]."""
        logistic, codes, offset = self.logistic, self.bins.codes, self.bins.offset
        make, groups = self.finders({m: trees[m] for m in asked})
        slots, nodes = {}, 0
        for m, own in asked.items():
            place = np.full(len(trees[m].nodes["feature"]), -1, np.intp)
            place[own] = np.arange(len(own))
            slots[m] = place, nodes, len(own)
            nodes += len(own)
        by = groups_for({x[2] for x in slots.values()}, np.diff(offset), offset[:-1])

        def run(blocks):
            total = {m: [np.zeros((2, many * cells)) for cells in by[many].cells] for m, (_, _, many) in slots.items()}
            made = make()
            for fold, rows, label, margins in blocks:
                numbers, to_sum = {}, {}
                for m, own, _, leaf in made:
                    if fold == own:
                        continue
                    place, _, many = slots[m]
                    y, slot, some = residual(logistic, first, label, margins[m]), None, None
                    if leaf is not None:
                        if own not in numbers:
                            numbers[own] = groups.numbers(rows[own])
                        slot = place.take(leaf(rows[own], numbers[own]))
                        some = np.flatnonzero(slot >= 0)
                        slot, y = slot.take(some), y.take(some)
                    here = own, id(by[many])
                    if here not in to_sum:
                        to_sum[here] = by[many].numbers(rows[own])
                    for i, (at, cells) in enumerate(zip(to_sum[here], by[many].cells, strict=True)):
                        key = at if some is None else at.take(some)
                        add_up(total[m][i], key if many == 1 else slot * cells + key, [None, y])
            for m, parts in total.items():
                many = slots[m][2]
                out = np.zeros((2, many, codes))
                for i, part in enumerate(parts):
                    for b, sums in by[many].by_bundle(i, part.reshape(2, many, -1)):
                        out[:, :, offset[b]:offset[b + 1]] = sums
                yield m, out.reshape(2, -1)

        parts = self.state.mapPartitions(run)
        if self.partitions * nodes * codes > DIRECT_COLLECT_MAX:
            parts = parts.reduceByKey(np.add, len(asked))
        out = np.zeros((nodes, 2, codes))
        for m, x in parts.collect():
            _, at, many = slots[m]
            out[at:at + many] += x.reshape(2, many, codes).swapaxes(0, 1)
        return out

    def scores(self, judge) -> dict[int, float]:
        """The metric of each model with a fold, on that fold's rows; classes are counted by label and prediction."""
        logistic, folds = self.logistic, [s.fold for s in self.specs]

        def run(blocks):
            total = np.zeros((len(folds), 4))
            for fold, _, y, margins in blocks:
                for m in (m for m, f in enumerate(folds) if f == fold):
                    total[m] += np.bincount(2 * (y > 0) + (margins[m] > 0), minlength=4) if logistic else [((margins[m] - y) ** 2).sum(), len(y), 0, 0]
            yield total

        out = {}
        for m, x in enumerate(sum(self.state.mapPartitions(run).collect())):
            if folds[m] == len(self.bins.cuts) - 1:
                continue
            if isinstance(judge, RegressionEvaluator):
                out[m] = float(np.sqrt(x[0] / x[1])) if x[1] else 0.0
            else:
                cells = [(i // 2 * 1.0, i % 2 * 1.0, float(c)) for i, c in enumerate(x) if c]
                out[m] = judge.copy({judge.weightCol: "n"}).evaluate(self.spark.createDataFrame(cells, "label double, prediction double, n double"))
        return out


def tuned(data: DataFrame, fold_col: str, points: list, num_folds: int, judge) -> tuple[list[float], list[HistBoostModel]] | None:
    """(mean metric over the folds, model of all rows) of each GBT estimator of ``points`` on [label, features, fold].

    None where the estimators or features ask for more than is done here, or the trees are too large for the driver to search.
    """
    if not points or not served(points):
        return None
    ship_package(data.sparkSession)
    n = width(data, "features")
    binary = binary_features(data, n)
    if binary is None:
        return None
    logistic, max_bins = isinstance(points[0], GBTClassifier), points[0].getOrDefault("maxBins")
    data = data.select("features", F.col("label").cast("double").alias("label"), F.col(fold_col).cast("int").alias("fold"))
    sizes = {r["fold"]: r for r in data.groupBy("fold").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).collect()}
    if logistic and not all({r["least"], r["most"]} <= {0.0, 1.0} for r in sizes.values()):
        raise ValueError("a GBT classifier requires labels 0 and 1")
    cuts = []
    for fold in range(num_folds + 1):
        count = sum(r["n"] for f, r in sizes.items() if f != fold)
        if not count:
            raise ValueError("empty training data")
        cuts.append(thresholds(data.where(F.col("fold") != fold), n, binary, count, max_bins))
    bins = Bins(cuts, binary, bundle_starts(data, "features", n) if binary.any() else np.arange(n))
    deepest = max(p.getOrDefault("maxDepth") for p in points)
    specs = [Spec(p.getOrDefault("maxDepth"), p.getOrDefault("maxIter"), p.getOrDefault("stepSize"), p.getOrDefault("minInstancesPerNode"),
                  p.getOrDefault("minInfoGain"), fold) for p in points for fold in range(num_folds + 1)]
    if 2 ** max(0, deepest - 1) * bins.codes * len(specs) > MOST_CELLS:
        return None
    fit = Fit(data, bins, specs, logistic, sum(r["n"] for r in sizes.values()))
    try:
        fit.run()
        scores = fit.scores(judge)
    finally:
        fit.close()
    averages, models = [], []
    for i, p in enumerate(points):
        own = range(i * (num_folds + 1), (i + 1) * (num_folds + 1) - 1)
        averages.append(sum(scores[m] for m in own) / num_folds)
        model = HistBoostModel(featuresCol=p.getOrDefault("featuresCol"), predictionCol=p.getOrDefault("predictionCol"), numFeatures=n,
                               objective="binary:logistic" if logistic else "reg:squarederror")
        models.append(model.with_nodes(_node_table([specs[own.stop].trees])))
    return averages, models

"""Second-order histogram gradient boosting (T9-T14) as a pyspark.ml Estimator.

Published method (Chen & Guestrin 2016; Ke et al. 2017), expressed as Spark jobs:

* features stay sparse; every value is binned once (``bins.py``: edges from a mergeable quantile summary, exclusive
  features in bundles).  The persisted state is blocks of rows of one fold: one code per bundle, the labels and the margins;
* any number of models (folds, grid points) grow in the same passes: a model reads the blocks
  of the other folds.  After each round all models' new trees are added to the margins in the pass that
  builds the next round's first histograms; every ``CUT_ROUNDS`` rounds the state becomes a reliable checkpoint;
* per pass, one job: rows find their node in the growing trees and add gradient, hessian
  and count into sums by (model, node, code), taken by groups of bundles (``coded.py``).  The sums of a feature's absent entries follow by difference;
* splits maximize
  gain = 1/2 [s(G_L)^2/(H_L+lambda) + s(G_R)^2/(H_R+lambda) - s(G)^2/(H+lambda)] - gamma,
  s = soft threshold by alpha, ``min_child_weight`` on H, a row minimum, and a learned default direction for
  missing values (null/NaN, and 0.0 when ``zeroAsMissing``).  They are chosen in Spark (a window per (model, node,
  feature), then the best of each node), which sends one row per node to the driver; where a pass has at most
  ``DRIVER_CELLS`` sums (a fixed bound), the sums are collected and searched there instead, which spares two stages,
  and only the smaller child's are built, the other's being the parent's less it;
* ``growth="depth"`` splits every splittable node per level (max_depth); ``growth="leaf"`` commits
  splits strictly by gain until ``num_leaves`` is reached; children of open leaves are looked at
  ahead, so one pass serves many splits.

Objectives: ``binary:logistic``, ``multi:softprob`` (K trees per round, grown in the same
passes) and ``reg:squarederror``.  A fitted model is a table of tree nodes, saved as Parquet; it scores with an Arrow
UDF over a broadcast of that table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package, spread
from .bins import FeatureBins, entries, find_bins
from .coded import BLOCK_ROWS, GROUP_CODES, Groups, Leaves, add_up, dealt, groups_for, leaf_masks
from .linalg import DIRECT_COLLECT_MAX, _batch_vector

OBJECTIVES = ("binary:logistic", "multi:softprob", "reg:squarederror")
#: rounds between two reliable checkpoints of the state
CUT_ROUNDS = 10
#: sums of one pass that the driver may search; beyond, Spark does
DRIVER_CELLS = 2_000_000
#: codes up to which the driver keeps an open node's sums, so that only the smaller child's need be built
KEPT_CODES = 1 << 14
#: sums in which the driver looks for splits at once
SPLIT_CELLS = 1 << 18
#: sums that a task holds densely; beyond, it sends the sums of each batch
TASK_CELLS = 4_000_000
#: (node, code) pairs of a tree whose side a task looks up; beyond, it is worked out row by row
SIDE_CELLS = 1 << 22
#: fold of rows without one
NO_FOLD = -1 << 40


# ---------------------------------------------------------------- trees

NODE = {"feature": -1, "bin": 0, "thr": 0.0, "default_left": True, "left": -1, "right": -1, "value": 0.0, "depth": 0}


def _new_tree() -> dict[str, list]:
    return {k: [v] for k, v in NODE.items()}


def _tree_np(t: dict) -> dict[str, np.ndarray]:
    return {k: np.asarray(v) for k, v in t.items()}


def _descend(t: dict, rows: int, goes_left) -> np.ndarray:
    """The leaf of each row; ``goes_left(rows, nodes)`` decides at inner nodes."""
    node = np.zeros(rows, np.int64)
    live = np.arange(rows)
    while len(live):
        live = live[t["feature"][node[live]] >= 0]
        at = node[live]
        node[live] = np.where(goes_left(live, at), t["left"][at], t["right"][at])
    return node


class Path:
    """A (partial) tree over binned rows: per node the bundle to look at and, where that fits, the side of every code."""

    def __init__(self, t: dict, bins: FeatureBins):
        self.t, self.bins, self.inner = t, bins, t["feature"] >= 0
        f = np.where(self.inner, t["feature"], 0)
        self.bundle, self.first, self.size, self.default = bins.bundle[f], bins.start[f] + 1, bins.start[f + 1] - bins.start[f], bins.default[f]
        self.child = np.stack([t["right"], t["left"]], axis=1).ravel()
        self.side = None
        if len(f) * (bins.codes + 1) <= SIDE_CELLS:
            self.side = self._left(np.arange(bins.codes + 1)[None, :], np.arange(len(f))[:, None])

    def _left(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = code - self.first[at]
        place = np.where((place >= 0) & (place < self.size[at]), place, self.default[at])
        return np.where(place == 0, self.t["default_left"][at], place <= self.t["bin"][at])

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(codes), np.int64)
        live = np.arange(len(codes)) if self.inner[0] else np.zeros(0, np.int64)
        while len(live):
            at = node[live]
            code = codes[live, self.bundle[at]]
            to = self.child[2 * at + (self._left(code, at) if self.side is None else self.side[at, code])]
            node[live] = to
            live = live[self.inner[to]]
        return node


def _grad_hess(objective: str, margins: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(gradient, hessian) of each class from [class, row]."""
    if objective == "binary:logistic":
        p = 1.0 / (1.0 + np.exp(-margins[0]))
        return [(p - y, np.maximum(p * (1.0 - p), 1e-16))]
    if objective == "reg:squarederror":
        return [(margins[0] - y, np.ones(len(y)))]
    p = np.exp(margins - margins.max(axis=0))
    p /= p.sum(axis=0)
    kind = y.astype(np.int64)
    return [(x - (kind == k), np.maximum(2.0 * x * (1.0 - x), 1e-16)) for k, x in enumerate(p)]


def _soft(G, alpha):
    return np.sign(G) * np.maximum(np.abs(G) - alpha, 0.0)


def _score(G, H, lam, alpha):
    s = _soft(G, alpha)
    with np.errstate(divide="ignore", invalid="ignore"):
        return s * s / (H + lam)


# ---------------------------------------------------------------- split search

@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int            # bins up to this one go left
    default_left: bool
    left: tuple         # (G, H) of the left child
    right: tuple


@dataclass(frozen=True)
class SplitRule:
    lam: float
    alpha: float
    gamma: float
    min_child_weight: float
    min_rows: int
    max_depth: int
    leaves: int | None  # leaf budget of best-first growth; None: level by level
    eta: float

    @property
    def least_rows(self) -> float:
        return max(1, self.min_rows) - 0.5  # subtracted counts are whole up to rounding


def whole_sums(sums: np.ndarray, total: np.ndarray, bins: FeatureBins) -> np.ndarray:
    """[G, H, C] by code with the absent entries' sums filled in: the node's total less the other bins'."""
    out = sums.copy()
    out[:, bins.start[:-1] + bins.default] += total[:, None] - np.add.reduceat(sums, bins.start[:-1], axis=1)
    return out


def best_split(sums: np.ndarray, total: np.ndarray, bins: FeatureBins, rule: SplitRule) -> Split | None:
    """Best split of one node from its whole sums; None when none has positive gain."""
    return best_splits(sums[None], total[None], bins, [rule])[0]


def best_splits(sums: np.ndarray, total: np.ndarray, bins: FeatureBins, rules: list[SplitRule]) -> list[Split | None]:
    """Best split of each node from the whole sums [node, (G, H, C), code]; None when none has positive gain.

    Of equal gains the first counts: missing values to the left, then the smaller feature, then the smaller bin.
    """
    size = np.diff(bins.start)
    first = bins.start[:-1]
    missing = sums[:, :, first]
    values = sums.copy()
    values[:, :, first] = 0.0
    cum = np.cumsum(values, axis=2)
    last = np.zeros(bins.codes, bool)
    last[first] = last[bins.start[1:] - 1] = True
    at = np.flatnonzero(~last)
    if not len(at):
        return [None] * len(rules)
    feat = np.repeat(np.arange(bins.n), size)[at]
    lam, alpha, gamma, weight, rows = (np.array([getattr(r, x) for r in rules])[:, None] for x in ("lam", "alpha", "gamma", "min_child_weight", "least_rows"))
    whole = total[:, :, None]
    parent = _score(whole[:, 0], whole[:, 1], lam, alpha)
    upto = cum[:, :, at] - cum[:, :, first[feat]]
    best: list = [None] * len(rules)
    for default_left in (True, False):
        L = upto + missing[:, :, feat] if default_left else upto
        R = whole - L
        ok = (L[:, 1] >= weight) & (R[:, 1] >= weight) & (L[:, 1] > 0) & (R[:, 1] > 0)
        ok &= (L[:, 2] > rows) & (R[:, 2] > rows)
        gain = 0.5 * (_score(L[:, 0], L[:, 1], lam, alpha) + _score(R[:, 0], R[:, 1], lam, alpha) - parent) - gamma
        gain = np.where(ok, gain, -np.inf)
        for s, i in enumerate(gain.argmax(axis=1).tolist()):
            if gain[s, i] > 0 and (best[s] is None or gain[s, i] > best[s].gain):
                j = int(feat[i])
                best[s] = Split(float(gain[s, i]), j, int(at[i] - first[j]), default_left, (float(L[s, 0, i]), float(L[s, 1, i])), (float(R[s, 0, i]), float(R[s, 1, i])))
    return best


def node_bins(sums: DataFrame, bins: FeatureBins, shared=None) -> tuple[DataFrame, DataFrame]:
    """([slot, feat, bin, size, g, h, c] with the absent entries' bins, [slot, G, H, C]) of [slot, code, g, h, c] summed over all rows."""
    shared = shared or sums.sparkSession.sparkContext.broadcast(bins)

    def run(batches):
        of = shared.value
        for b in batches:
            code = b.column(1).to_numpy()
            feat = np.searchsorted(of.start, code, side="right") - 1
            names = {"slot": b.column(0), "feat": pa.array(feat), "bin": pa.array(code - of.start[feat]), "absent": pa.array(of.default[feat]),
                     "size": pa.array(of.start[feat + 1] - of.start[feat]), **{x: b.column(2 + i) for i, x in enumerate("ghc")}}
            yield pa.RecordBatch.from_arrays(list(names.values()), names=list(names))

    total = sums.where(F.col("code") == bins.codes).select("slot", F.col("g").alias("G_all"), F.col("h").alias("H_all"), F.col("c").alias("C_all"))
    cells = sums.where(F.col("code") < bins.codes).select("slot", "code", *"ghc").mapInArrow(run, "slot long, feat long, bin long, absent long, size long, g double, h double, c double")
    # the bin that no row names: the node's total less the others
    rest = (cells.groupBy("slot", "feat", "absent", "size").agg(*[F.sum(x).alias(x) for x in "ghc"]).join(F.broadcast(total), "slot")
            .select("slot", "feat", F.col("absent").alias("bin"), "size", *[(F.col(f"{x.upper()}_all") - F.col(x)).alias(x) for x in "ghc"]))
    return cells.drop("absent").unionByName(rest.where(F.col("c") > 0.5)), total


def searched(sums: DataFrame, bins: FeatureBins, rules: list[SplitRule], shared=None) -> DataFrame:
    """Best split per slot, in Spark: [slot, G_all, H_all, split: struct or null]; ``rules`` gives each slot's rule.

    A window per (slot, feature) runs over at most ``maxBins`` + 2 bins; the best candidate of a slot is an aggregation,
    pre-aggregated in every task.  What is broadcast is a row per slot.
    """
    names = ("lam", "alpha", "gamma", "min_child_weight", "least_rows")
    by_slot = sums.sparkSession.createDataFrame([(s, *(float(getattr(r, n)) for n in names)) for s, r in enumerate(rules)], "slot long, " + ", ".join(f"{n} double" for n in names))
    every, total = node_bins(sums, bins, shared)
    total = total.join(F.broadcast(by_slot), "slot")
    upto = Window.partitionBy("slot", "feat").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("slot", "feat")
    valued = lambda x: F.when(F.col("bin") > 0, F.col(x)).otherwise(0.0)
    cand = every.select("slot", "feat", "bin", "size",
                        *[F.sum(valued(x)).over(upto).alias(f"{x}l") for x in "ghc"],
                        *[F.sum(F.when(F.col("bin") == 0, F.col(x)).otherwise(0.0)).over(whole).alias(f"{x}m") for x in "ghc"])
    cand = cand.where((F.col("bin") > 0) & (F.col("bin") < F.col("size") - 1)).join(F.broadcast(total), "slot")
    cand = cand.withColumn("default_left", F.explode(F.array(F.lit(True), F.lit(False))))
    for x in "ghc":
        cand = cand.withColumn(f"{x}l", F.col(f"{x}l") + F.when(F.col("default_left"), F.col(f"{x}m")).otherwise(0.0))

    def score(g: Column, h: Column) -> Column:
        s = F.signum(g) * F.greatest(F.abs(g) - F.col("alpha"), F.lit(0.0))
        return s * s / (h + F.col("lam"))

    gl, hl, cl = (F.col(f"{x}l") for x in "ghc")
    gr, hr, cr = F.col("G_all") - gl, F.col("H_all") - hl, F.col("C_all") - cl
    ok = (hl >= F.col("min_child_weight")) & (hr >= F.col("min_child_weight")) & (hl > 0) & (hr > 0) & (cl > F.col("least_rows")) & (cr > F.col("least_rows"))
    gain = 0.5 * (score(gl, hl) + score(gr, hr) - score(F.col("G_all"), F.col("H_all"))) - F.col("gamma")
    cand = cand.where(ok).withColumn("gain", gain).where("gain > 0")
    # descending gain, then missing to the left, then the smaller feature and bin
    order = F.struct("gain", "default_left", (-F.col("feat")).alias("f"), (-F.col("bin")).alias("b"))
    best = cand.groupBy("slot").agg(F.max_by(F.struct("gain", "feat", "bin", "default_left", gl.alias("gl"), hl.alias("hl"), gr.alias("gr"), hr.alias("hr")), order).alias("split"))
    return total.select("slot", "G_all", "H_all").join(best, "slot", "left")


# ---------------------------------------------------------------- growth

class Grower:
    """One tree while it grows.

    A leaf's best split is known once its sums have been searched.  To spare a pass per split, open leaves get
    tentative children, which the next pass looks at ahead; splits are committed strictly by gain (best-first) or all at
    once (by level), and tentative children of leaves that never split are dropped in the end.  Where the driver
    has the sums, only the smaller child's are asked for.
    """

    def __init__(self, rule: SplitRule, bins: FeatureBins):
        self.rule, self.bins = rule, bins
        self.tree = _new_tree()
        self.sums: dict[int, tuple] = {}        # node -> (sums, total) as long as children may need them
        self.total: dict[int, tuple] = {}       # node -> (G, H)
        self.best: dict[int, Split | None] = {}
        self.open = {0}                         # leaves of the committed tree that may still split
        self.inner: set[int] = set()
        self.children: dict[int, tuple[int, int]] = {}  # small child -> (large child, parent)

    def arrays(self) -> dict:
        return _tree_np(self.tree)

    def wanted(self, subtract: bool) -> list[int]:
        if 0 not in self.best:
            return [0]
        if self.rule.leaves is not None and len(self.inner) + 1 >= self.rule.leaves:
            return []
        asked = []
        for leaf in sorted(self.open):
            if self.best.get(leaf) is not None and self.tree["left"][leaf] < 0:
                asked += self._split(leaf, subtract)
        return asked

    def _split(self, node: int, subtract: bool) -> list[int]:
        """Tentative children of a leaf; returns those whose sums must be built, if they may split."""
        best, t = self.best[node], self.tree
        edges = self.bins.edges[best.feature]
        left = len(t["feature"])
        made = {"feature": best.feature, "bin": best.bin, "thr": float(edges[best.bin - 1]) if best.bin - 1 < len(edges) else math.inf,
                "default_left": best.default_left, "left": left, "right": left + 1}
        for key, val in made.items():
            t[key][node] = val
        depth = t["depth"][node] + 1
        for child, total in ((left, best.left), (left + 1, best.right)):
            for key, val in NODE.items():
                t[key].append(depth if key == "depth" else val)
            self.total[child] = total
            if depth >= self.rule.max_depth:
                self.best[child] = None
        if depth >= self.rule.max_depth:
            return []
        if not subtract:
            return [left, left + 1]
        small, large = (left, left + 1) if best.left[1] <= best.right[1] else (left + 1, left)
        self.children[small] = (large, node)
        return [small]

    def receive_sums(self, node: int, sums: np.ndarray, total: np.ndarray, keep: bool) -> list[tuple]:
        """(node, whole sums, total) of the node and of the one that follows from it; their splits are still to be received."""
        known = [(node, whole_sums(sums, total, self.bins), total)]
        if node in self.children:
            other, parent = self.children.pop(node)
            above = self.sums.pop(parent)
            known.append((other, above[0] - known[0][1], above[1] - total))
        if keep:
            self.sums.update((x, (own, all_)) for x, own, all_ in known)
        return known

    def give_up_sums(self) -> list[int]:
        """The larger children that were to follow by subtraction."""
        large = [x for x, _ in self.children.values()]
        self.children.clear()
        self.sums.clear()
        return large

    def receive(self, node: int, best: Split | None, total: tuple) -> None:
        self.best[node] = best
        if node == 0:
            self.total[0] = total

    def commit(self) -> bool:
        """Commit what may be; whether anything was."""
        before = len(self.inner)
        while True:
            ready = [(self.best[x].gain, -x) for x in self.open if self.best.get(x) is not None and self.tree["left"][x] >= 0]
            if not ready:
                break
            if self.rule.leaves is None:
                chosen = [-x for _, x in ready]
            else:
                if len(self.inner) + 1 >= self.rule.leaves or any(x not in self.best for x in self.open):
                    break
                gains = [(self.best[x].gain, -x) for x in self.open if self.best[x] is not None]
                if max(gains) not in ready:
                    break  # the best leaf's children are not there yet
                chosen = [-max(ready)[1]]
            for x in chosen:
                self.open.remove(x)
                self.inner.add(x)
                self.open |= {self.tree["left"][x], self.tree["right"][x]}
        return len(self.inner) > before

    def finish(self) -> dict:
        """The committed tree, renumbered, with leaf values."""
        kept, todo = [], [0]
        while todo:
            node = todo.pop(0)
            kept.append(node)
            if node in self.inner:
                todo += [self.tree["left"][node], self.tree["right"][node]]
        number = {node: i for i, node in enumerate(kept)}
        out = {key: [] for key in NODE}
        for node in kept:
            split = node in self.inner
            for key, blank in NODE.items():
                out[key].append(self.tree[key][node] if split or key == "depth" else blank)
            if split:
                out["left"][-1], out["right"][-1] = number[self.tree["left"][node]], number[self.tree["right"][node]]
            else:
                G, H = self.total[node]
                out["value"][-1] = float(-self.rule.eta * _soft(G, self.rule.alpha) / (H + self.rule.lam)) if H + self.rule.lam > 0 else 0.0
        return out


@dataclass
class Spec:
    """One model of a fit: its rule, its rounds, and the fold whose rows it must not learn from (None: all rows)."""
    rule: SplitRule
    rounds: int
    fold: int | None = None
    base: np.ndarray | None = None
    trees: list = field(default_factory=list)   # per class


class Fit:
    """All models of ``specs``, grown together over one state: an RDD of blocks (fold, codes [bundle, row], label, margins
    [model and class, row]) of one fold each.  A code is 0 where all features of the bundle are at their default, else the code
    of the entry's bin, counted from 1 in its bundle."""

    def __init__(self, data: DataFrame, bins: FeatureBins, objective: str, K: int, specs: list[Spec], search: str, rows: int = 0):
        self.spark, self.bins, self.objective, self.K, self.specs, self.search = data.sparkSession, bins, objective, K, specs, search
        self.sc = self.spark.sparkContext
        self.shared = self.sc.broadcast(bins)
        self.first, self.sizes = bundle_codes(bins)
        self.state = self._binned(data, rows).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None
        self.partitions = self.state.getNumPartitions()
        self.passes = 0

    def _binned(self, data: DataFrame, rows: int) -> RDD:
        shared, first, width, base = self.shared, self.first, self.bins.width, np.concatenate([s.base for s in self.specs])
        most = int(self.sizes.max())
        kind = np.uint8 if most <= 1 << 8 else np.uint16 if most <= 1 << 16 else np.int32

        def run(batches):
            held: dict[int, list] = {}

            def block(fold: int) -> pa.RecordBatch:
                codes, label = zip(*held.pop(fold), strict=True)
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate(codes, axis=1), np.concatenate(label))]
                return pa.RecordBatch.from_arrays([pa.array([fold], pa.int64()), *raw], names=["fold", "codes", "label"])

            for b in batches:
                if not b.num_rows:
                    continue
                codes = shared.value.rows(b.column(0)).T
                codes = np.where(codes > 0, codes - first[:, None], 0).astype(kind)
                label, folds = _batch_vector(b, "label"), b.column(2).cast(pa.int64()).fill_null(NO_FOLD).to_numpy()
                for fold in np.unique(folds).tolist():
                    held.setdefault(fold, []).append((codes[:, folds == fold], label[folds == fold]))
                    if sum(len(y) for _, y in held[fold]) >= BLOCK_ROWS:
                        yield block(fold)
            for fold in list(held):
                yield block(fold)

        def unpacked(r):
            y = np.frombuffer(r["label"])
            return r["fold"], np.frombuffer(r["codes"], kind).reshape(width, -1), y, np.tile(base[:, None], (1, len(y)))

        blocks = data.select("features", "label", "fold").mapInArrow(run, "fold long, codes binary, label binary")
        return (dealt(blocks, rows, np.dtype(kind).itemsize * width + 8 + 8 * len(base)) if rows else blocks).rdd.map(unpacked)

    def finders(self, trees: dict[tuple[int, int], dict]):
        """(a function that makes (model, class) -> (leaf of each block's rows, or None where the root is one) for the tasks, the
        groups whose numbers that takes)."""
        shared, groups, first, bins, masks = self.shared, Groups(self.sizes, GROUP_CODES), self.first, self.bins, {}
        for mk, t in trees.items():
            inner = t["feature"] >= 0
            if Leaves.served(int(inner.sum()) + 1, groups) and inner[0]:
                bundle = bins.bundle[np.maximum(t["feature"], 0)]
                masks[mk] = leaf_masks(np.where(inner, t["left"], -1), t["right"], bundle, lambda nodes, b, t=t: sides(t, nodes, bins, first[b], groups.sizes[b]))
        rest = {mk: t for mk, t in trees.items() if mk not in masks and t["feature"][0] >= 0}
        names = list(trees)

        def make() -> dict:
            out: dict = dict.fromkeys(names)
            for mk, found in masks.items():
                out[mk] = lambda rows, numbers, x=Leaves(*found, groups): x.node.take(x.places(numbers))
            for mk, t in rest.items():
                out[mk] = lambda rows, numbers, x=Path(t, shared.value): x.leaves(np.where(rows > 0, rows + first[:, None], 0).T)
            return out

        return make, groups

    def add_trees(self, new: list[list[dict]], cut: bool) -> None:
        """The state with one more tree per model and class; it is built by the next pass over it."""
        K = self.K
        trees = {(m, k): _tree_np(t) for m, ts in enumerate(new) for k, t in enumerate(ts) if t is not None}
        make, groups = self.finders(trees)

        def run(blocks):
            found = make()
            for fold, codes, label, margins in blocks:
                margins, numbers = margins.copy(), groups.numbers(codes)
                for (m, k), leaf in found.items():
                    value = trees[m, k]["value"]
                    margins[m * K + k] += value[0] if leaf is None else value.take(leaf(codes, numbers))
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
        self.shared.destroy()

    def run(self) -> None:
        for s in self.specs:
            s.trees = [[] for _ in range(self.K)]
        last = max((s.rounds for s in self.specs), default=0)
        for r in range(1, last + 1):
            growers = {(m, k): Grower(s.rule, self.bins) for m, s in enumerate(self.specs) if r <= s.rounds for k in range(self.K)}
            self._grow(growers)
            new = [[growers[m, k].finish() if (m, k) in growers else None for k in range(self.K)] for m in range(len(self.specs))]
            for (m, k) in growers:
                self.specs[m].trees[k].append(new[m][k])
            self.add_trees(new, cut=r % CUT_ROUNDS == 0 and r < last)

    def _grow(self, growers: dict[tuple[int, int], Grower]) -> None:
        while True:
            subtract = self.search != "spark" and self.bins.codes <= KEPT_CODES
            slots = [(mk, node) for mk, g in growers.items() for node in g.wanted(subtract)]
            if not slots:
                # children at the greatest depth need no sums: their parents' splits are still to be committed
                if not any([g.commit() for g in growers.values()]):
                    return
                continue
            if self.search == "spark" or (self.search == "auto" and len(slots) * self.bins.codes > DRIVER_CELLS):
                # no sums come to the driver: the larger children are asked for too
                slots += [(mk, large) for mk, g in growers.items() for large in g.give_up_sums()]
                self._searched(growers, slots)
            else:
                self._split(growers, slots, self._collected(growers, slots), subtract)
            for g in growers.values():
                g.commit()

    def _split(self, growers, slots, sums: np.ndarray, keep: bool) -> None:
        """Finds and hands out the best splits of the slots' nodes, and of the nodes that follow by subtraction, many at a time."""
        many = max(1, SPLIT_CELLS // self.bins.codes)
        for lo in range(0, len(slots), many):
            known = [(growers[mk], *x) for (mk, node), own in zip(slots[lo:lo + many], sums[lo:lo + many], strict=True)
                     for x in growers[mk].receive_sums(node, own[:, :-1], own[:, -1], keep)]
            deep = [g.tree["depth"][node] < g.rule.max_depth for g, node, _, _ in known]
            open_ = [x for x, d in zip(known, deep, strict=True) if d]
            found = iter(best_splits(np.stack([x[2] for x in open_]), np.stack([x[3] for x in open_]), self.bins, [x[0].rule for x in open_]) if open_ else [])
            for (g, node, _, total), d in zip(known, deep, strict=True):
                g.receive(node, next(found) if d else None, (float(total[0]), float(total[1])))

    def summed(self, growers, slots) -> DataFrame:
        """[slot, code, g, h, c] over all rows."""
        codes = self.bins.codes
        parts, dense = self._parts(growers, slots)

        def cells(parts):
            for to, total in parts:
                if dense:
                    flat = total.reshape(3, -1)
                    at = np.flatnonzero(flat[2])
                    slot, code, sums = to[at // (codes + 1)], at % (codes + 1), flat[:, at]
                else:
                    slot, code, sums = to // (codes + 1), to % (codes + 1), total
                sink = pa.BufferOutputStream()
                table = pa.table([pa.array(slot), pa.array(code), *(pa.array(x) for x in sums)], names=["slot", "code", *"ghc"])
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table, max_chunksize=1 << 16)
                yield (bytearray(sink.getvalue()),)

        def read(batches):
            for b in batches:
                for x in b.column(0):
                    yield from pa.ipc.open_stream(x.as_buffer())

        rows = self.spark.createDataFrame(parts.mapPartitions(cells), "cells binary").mapInArrow(read, "slot long, code long, g double, h double, c double")
        return rows.groupBy("slot", "code").agg(*[F.sum(x).alias(x) for x in "ghc"])

    def _searched(self, growers, slots) -> None:
        for mk, node in slots:  # holds for nodes without rows
            growers[mk].receive(node, None, (0.0, 0.0))
        for r in searched(self.summed(growers, slots), self.bins, [growers[mk].rule for mk, _ in slots], self.shared).collect():
            (mk, node), s = slots[r["slot"]], r["split"]
            g = growers[mk]
            split = None
            if s is not None and g.tree["depth"][node] < g.rule.max_depth:
                split = Split(s["gain"], s["feat"], s["bin"], s["default_left"], (s["gl"], s["hl"]), (s["gr"], s["hr"]))
            g.receive(node, split, (r["G_all"], r["H_all"]))

    def _collected(self, growers, slots) -> np.ndarray:
        """[slot, (G, H, C), code]."""
        S, width = len(slots), self.bins.codes + 1
        parts, dense = self._parts(growers, slots)
        out = np.zeros((S, 3, width))
        if not dense:
            table = self.summed(growers, slots).toArrow()
            at = table["slot"].to_numpy() * width + table["code"].to_numpy()
            return np.stack([np.bincount(at, table[x].to_numpy(), S * width).reshape(S, width) for x in "ghc"], axis=1)
        if self.partitions * S * width > DIRECT_COLLECT_MAX:
            # a tree's sums meet in one task
            parts = parts.map(lambda x: (int(x[0][0]), x)).reduceByKey(lambda a, b: (a[0], a[1] + b[1])).values()
        for to, total in parts.collect():
            out[to] += total.swapaxes(0, 1)
        return out

    def _parts(self, growers, slots) -> tuple[RDD, bool]:
        """Sums over the rows of a task, one entry per tree: (its slots, [(G, H, C), slot, code]), where code = number of codes is a
        slot's total; or else, if those were too many, entries (slot * (codes + 1) + code, [(G, H, C), ...]) per block and tree."""
        self.passes += 1
        place: dict[tuple, dict[int, int]] = {}
        for s, (mk, node) in enumerate(slots):
            place.setdefault(mk, {})[node] = s
        trees = {mk: growers[mk].arrays() for mk in place}
        asked = {}
        for mk, where in place.items():
            own = np.full(len(trees[mk]["feature"]), -1, np.intp)
            own[list(where)] = np.arange(len(where))
            asked[mk] = own, np.array(list(where.values()))
        S, K, codes, first, sizes = len(slots), self.K, self.bins.codes, self.first, self.sizes
        objective, folds = self.objective, [s.fold for s in self.specs]
        make, groups = self.finders(trees)
        dense = S * (codes + 1) <= TASK_CELLS
        by = groups_for({len(to) for _, to in asked.values()}, sizes) if dense else {}

        def run(blocks):
            found = make()
            total = {mk: [np.zeros((3, len(to) * cells)) for cells in by[len(to)].cells] for mk, (_, to) in asked.items()} if dense else {}
            for fold, rows, y, margins in blocks:
                numbers = groups.numbers(rows)
                to_sum = {id(g): g.numbers(rows) for g in {id(x): x for x in by.values()}.values()}
                known: dict[int, tuple] = {}
                for (m, k), (own, to) in asked.items():
                    if folds[m] == fold:
                        continue
                    if m not in known:
                        known[m] = _grad_hess(objective, margins[m * K:(m + 1) * K], y)
                    g, h = known[m][k]
                    slot, some = None, None
                    if found[m, k] is not None:
                        slot = own.take(found[m, k](rows, numbers))
                        some = np.flatnonzero(slot >= 0)
                        if not len(some):
                            continue
                        if len(some) == len(slot):
                            some = None
                        else:
                            slot, g, h = slot.take(some), g.take(some), h.take(some)
                    if not dense:
                        yield sparse(rows if some is None else rows[:, some], slot, to, g, h)
                        continue
                    for i, (at, cells) in enumerate(zip(to_sum[id(by[len(to)])], by[len(to)].cells, strict=True)):
                        key = at if some is None else at.take(some)
                        add_up(total[m, k][i], key if len(to) == 1 else slot * cells + key, [g, h, None])
            for mk, parts in total.items():
                to, n = asked[mk][1], by[len(asked[mk][1])]
                out = np.zeros((3, len(to), codes + 1))
                for i, part in enumerate(parts):
                    part = part.reshape(3, len(to), -1)
                    for b, sums in n.by_bundle(i, part):
                        out[:, :, first[b]:first[b] + sizes[b] - 1] = sums[:, :, 1:]
                    if not i:
                        out[:, :, codes] = part.sum(axis=2)
                yield to, out

        def sparse(rows, slot, to, g, h):
            w, row = np.nonzero(rows)
            slot = np.zeros(len(g), np.intp) if slot is None else slot
            slot = to[slot] * (codes + 1)
            keys, back = np.unique(np.concatenate([slot[row] + rows[w, row] + (first[w] - 1), slot + codes]), return_inverse=True)
            return keys, np.stack([np.bincount(back, np.concatenate([x[row], x]), len(keys)) for x in (g, h, np.ones(len(g)))])

        return self.state.mapPartitions(run), dense

    def scores(self, task: str) -> dict[int, float]:
        """Metric of each model with a fold, on that fold's rows; one pass over the state."""
        K, folds = self.K, [s.fold for s in self.specs]

        def run(blocks):
            cells: dict[int, dict] = {}
            for fold, _, y, margins in blocks:
                for m in (m for m, f in enumerate(folds) if f == fold):
                    own, mine = margins[m * K:(m + 1) * K], cells.setdefault(m, {})
                    if task == "regression":
                        e = own[0] - y
                        found = [("e", float(e @ e)), ("n", len(y))]
                    else:
                        said = own.argmax(axis=0) if task == "multi" else own[0] > 0
                        pairs, count = np.unique(np.stack([y, said.astype(np.float64)]), axis=1, return_counts=True)
                        found = zip(map(tuple, pairs.T.tolist()), count.tolist(), strict=True)
                    for key, n in found:
                        mine[key] = mine.get(key, 0) + n
            yield from cells.items()

        cells: dict[int, dict] = {}
        for m, part in self.state.mapPartitions(run).collect():
            mine = cells.setdefault(m, {})
            for key, n in part.items():
                mine[key] = mine.get(key, 0) + n
        if task == "regression":
            return {m: math.sqrt(c["e"] / c["n"]) for m, c in cells.items()}
        return {m: (_hard_auc if task == "binary" else _weighted_f1)(c) for m, c in cells.items()}


def bundle_codes(bins: FeatureBins) -> tuple[np.ndarray, np.ndarray]:
    """First code, and number of codes with that of the default, of each bundle."""
    ends = np.r_[np.flatnonzero(np.diff(bins.bundle)) + 1, bins.n]
    first = bins.start[np.r_[0, ends[:-1]]]
    return first, bins.start[ends] - first + 1


def sides(t: dict, nodes: np.ndarray, bins: FeatureBins, first: int, size: int) -> np.ndarray:
    """Whether rows go left at the inner ``nodes``, whose features are of one bundle, by their code in it: [node, code]."""
    f, code = t["feature"][nodes][:, None], np.arange(size)
    place = code + (first - 1 - bins.start[f])
    place = np.where((place >= 0) & (place < bins.start[f + 1] - bins.start[f]) & (code > 0), place, bins.default[f])
    return np.where(place == 0, t["default_left"][nodes][:, None], place <= t["bin"][nodes][:, None])


# ---------------------------------------------------------------- the estimator

class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    objective = Param(Params._dummy(), "objective", "one of " + ", ".join(OBJECTIVES), typeConverter=TypeConverters.toString)
    numRound = Param(Params._dummy(), "numRound", "boosting rounds", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "max depth (-1: unlimited for leaf growth)", typeConverter=TypeConverters.toInt)
    eta = Param(Params._dummy(), "eta", "learning rate", typeConverter=TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "minimum split gain", typeConverter=TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "minimum hessian per child", typeConverter=TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 on leaf weights", typeConverter=TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 on leaf weights", typeConverter=TypeConverters.toFloat)
    zeroAsMissing = Param(Params._dummy(), "zeroAsMissing", "treat 0.0 as missing", typeConverter=TypeConverters.toBoolean)
    maxBins = Param(Params._dummy(), "maxBins", "histogram bins per feature", typeConverter=TypeConverters.toInt)
    growth = Param(Params._dummy(), "growth", "depth | leaf", typeConverter=TypeConverters.toString)
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves per tree (leaf growth)", typeConverter=TypeConverters.toInt)
    boostFromAverage = Param(Params._dummy(), "boostFromAverage", "start from the label mean / log-odds", typeConverter=TypeConverters.toBoolean)
    numClass = Param(Params._dummy(), "numClass", "classes for multi:softprob (0: from data)", typeConverter=TypeConverters.toInt)
    minDataInLeaf = Param(Params._dummy(), "minDataInLeaf", "minimum rows per child", typeConverter=TypeConverters.toInt)
    splitSearch = Param(Params._dummy(), "splitSearch", "auto | driver | spark", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(minDataInLeaf=0, objective="binary:logistic", numRound=20, maxDepth=6, eta=0.3, gamma=0.0,
                         minChildWeight=1.0, regLambda=1.0, regAlpha=0.0, zeroAsMissing=False, maxBins=64,
                         growth="depth", numLeaves=31, boostFromAverage=False, numClass=0, splitSearch="auto")


class HistBoost(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 objective="binary:logistic", numRound=20, maxDepth=6, eta=0.3, gamma=0.0, minChildWeight=1.0,
                 regLambda=1.0, regAlpha=0.0, zeroAsMissing=False, maxBins=64, growth="depth", numLeaves=31,
                 boostFromAverage=False, numClass=0, minDataInLeaf=0, splitSearch="auto"):
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **kwargs):
        return self._set(**kwargs)

    def _fit(self, dataset: DataFrame) -> HistBoostModel:
        (model,), fit = fit_many(dataset.withColumn("_fold", F.lit(-1)), [(self, None)], "_fold")
        fit.close()
        return model

    def rule(self) -> SplitRule:
        g = self.getOrDefault
        return SplitRule(g(self.regLambda), g(self.regAlpha), g(self.gamma), g(self.minChildWeight), g(self.minDataInLeaf),
                         g(self.maxDepth) if g(self.maxDepth) >= 0 else 64, g(self.numLeaves) if g(self.growth) == "leaf" else None, g(self.eta))

    def shared(self) -> tuple:
        """What models of one fit have in common."""
        g = self.getOrDefault
        return tuple(g(p) for p in (self.objective, self.zeroAsMissing, self.maxBins, self.numClass, self.boostFromAverage, self.splitSearch,
                                    self.featuresCol, self.labelCol, self.predictionCol))


def fit_many(dataset: DataFrame, models: list[tuple[HistBoost, int | None]], fold_col: str) -> tuple[list[HistBoostModel], Fit]:
    """(fitted models, the fit with its state [.., label, fold, margins: per model and class]) of all ``models`` in common passes.

    Each entry of ``models`` is an estimator and the fold it must not learn from (None: it learns from all rows).  The
    caller closes the fit.
    """
    est = models[0][0]
    objective, zero_missing, max_bins, num_class, from_average, search, features, label, _ = est.shared()
    if any(m.shared() != est.shared() for m, _ in models):
        raise ValueError("models of one fit share objective, bins, classes, start, search and columns")
    if objective not in OBJECTIVES:
        raise ValueError(f"objective {objective!r} not in {OBJECTIVES}")
    if not 2 <= max_bins <= 1 << 20:
        raise ValueError("maxBins must lie in 2 .. 2^20")
    ship_package(dataset.sparkSession)
    data = dataset.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"), F.col(fold_col).cast("int").alias("fold"))
    held = dataset.is_cached
    data = data if held else spread(data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = data.groupBy("fold").agg(F.count("*").alias("n"), F.max("label").alias("most"), F.sum("label").alias("s")).collect()
        if not stats:
            raise ValueError("empty training data")
        K = 1 if objective != "multi:softprob" else num_class or int(max(r["most"] for r in stats)) + 1
        specs = []
        for m, fold in models:
            n, s = (sum(r[c] for r in stats if r["fold"] != fold) for c in ("n", "s"))
            base = np.zeros(K)
            if from_average and objective == "binary:logistic":
                p = min(max(s / n, 1e-6), 1 - 1e-6)
                base[:] = math.log(p / (1 - p))
            elif from_average and objective == "reg:squarederror":
                base[:] = s / n
            specs.append(Spec(m.rule(), m.getOrDefault(m.numRound), fold, base))
        bins = find_bins(data.select("features"), "features", max_bins, zero_missing)
        fit = Fit(data, bins, objective, K, specs, search, sum(r["n"] for r in stats))
        fit.run()
    finally:
        if not held:
            data.unpersist()
    fitted = []
    for (m, _), s in zip(models, specs, strict=True):
        model = HistBoostModel(featuresCol=features, predictionCol=m.getOrDefault(m.predictionCol), objective=objective,
                               zeroAsMissing=zero_missing, base=s.base.tolist(), numFeatures=bins.n)
        fitted.append(model.with_nodes(_node_table(s.trees)))
    return fitted, fit


def tuned(data: DataFrame, fold_col: str, points: list[HistBoost], num_folds: int, task: str) -> tuple[list[float], list[HistBoostModel]]:
    """(mean metric over the folds, model of all rows) of each grid point; all folds and points grow in the same passes.

    The metric of a fold comes from the margins of its rows: AUC of the hard prediction (binary), weighted F1 (multi) or
    root mean squared error.
    """
    averages: list = [None] * len(points)
    finals: list = [None] * len(points)
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        groups.setdefault(p.shared(), []).append(i)
    for members in groups.values():
        models = [(points[i], fold) for i in members for fold in (*range(num_folds), None)]
        fitted, fit = fit_many(data, models, fold_col)
        scores = fold_scores(fit, task)
        fit.close()
        for at, i in enumerate(members):
            first = at * (num_folds + 1)
            averages[i] = sum(scores[first + f] for f in range(num_folds)) / num_folds
            finals[i] = fitted[first + num_folds]
    return averages, finals


def fold_scores(fit: Fit, task: str) -> dict[int, float]:
    """Metric of each model with a fold, on that fold's rows; one pass over the state."""
    return fit.scores(task)


def _hard_auc(cells: dict) -> float:
    pos, neg = (sum(n for (y, _), n in cells.items() if (y == 1.0) == want) for want in (True, False))
    return 0.5 * (cells.get((1.0, 1.0), 0) / max(1, pos) + cells.get((0.0, 0.0), 0) / max(1, neg))


def _weighted_f1(cells: dict) -> float:
    total, out = sum(cells.values()), 0.0
    for y in {y for y, _ in cells}:
        hit, have, said = cells.get((y, y), 0), sum(n for (a, _), n in cells.items() if a == y), sum(n for (_, p), n in cells.items() if p == y)
        out += have / total * (2 * hit / (have + said))
    return out


NODES = T.StructType([T.StructField("klass", T.IntegerType()), T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
                      T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("default_left", T.BooleanType()),
                      T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("value", T.DoubleType())])


def _node_table(trees: list[list[dict]]) -> pa.Table:
    flat: dict[str, list] = {n: [] for n in NODES.names}
    for k, ts in enumerate(trees):
        for i, t in enumerate(ts):
            n = len(t["feature"])
            for name, values in (("klass", [k] * n), ("tree", [i] * n), ("node", range(n)), ("feature", t["feature"]), ("threshold", t["thr"]),
                                 ("default_left", [bool(x) for x in t["default_left"]]), ("left", t["left"]), ("right", t["right"]), ("value", t["value"])):
                flat[name] += values
    kinds = {"threshold": pa.float64(), "value": pa.float64(), "default_left": pa.bool_()}
    return pa.table({n: pa.array(v, kinds.get(n, pa.int32())) for n, v in flat.items()})


class Forest:
    """The trees of a node table, as arrays, for scoring raw feature vectors."""

    def __init__(self, nodes: pa.Table, base: np.ndarray, zero_missing: bool):
        nodes = nodes.sort_by([("klass", "ascending"), ("tree", "ascending"), ("node", "ascending")])
        col = {n: nodes[n].to_numpy() for n in NODES.names}
        first = np.flatnonzero(col["node"] == 0)
        cuts = np.r_[first, nodes.num_rows]
        # only features that some split uses are ever looked up
        self.used = np.unique(np.r_[0, col["feature"][col["feature"] >= 0]])
        col["feature"] = np.where(col["feature"] >= 0, np.searchsorted(self.used, col["feature"]), -1)
        self.trees = [(int(col["klass"][a]), {n: col[n][a:b] for n in ("feature", "threshold", "default_left", "left", "right", "value")}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.base, self.zero_missing = base, zero_missing

    def margins(self, col: pa.Array, n: int) -> np.ndarray:
        row, feat, value = entries(col, n)
        at = np.minimum(np.searchsorted(self.used, feat), len(self.used) - 1)
        mine = self.used[at] == feat
        X = np.zeros((len(col), len(self.used)))
        X[row[mine], at[mine]] = value[mine]
        missing = np.isnan(X) | ((X == 0.0) & self.zero_missing)
        out = np.tile(self.base, (len(col), 1))
        for k, t in self.trees:
            def goes_left(rows, nodes, t=t):
                f = t["feature"][nodes]
                return np.where(missing[rows, f], t["default_left"][nodes], X[rows, f] <= t["threshold"][nodes])

            out[:, k] += t["value"][_descend(t, len(col), goes_left)]
        return out


def _width(col: pa.Array) -> int:
    """Width of the first vector."""
    if not len(col):
        return 0
    x = col[0].as_py()
    if x is None:
        raise ValueError("some rows have no feature vector")
    return len(x) if isinstance(x, list) else (x["size"] if x["type"] == 0 else len(x["values"]))


# ---------------------------------------------------------------- the model

class HistBoostModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Trees as a table of nodes (one row per node), broadcast once for scoring and saved as Parquet beside the parameters."""

    objective = Param(Params._dummy(), "objective", "objective", typeConverter=TypeConverters.toString)
    zeroAsMissing = Param(Params._dummy(), "zeroAsMissing", "treat 0.0 as missing", typeConverter=TypeConverters.toBoolean)
    base = Param(Params._dummy(), "base", "starting margin per class", typeConverter=TypeConverters.toListFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "features a row must have (0: as many as the first)", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", objective="binary:logistic", zeroAsMissing=False, base=None, numFeatures=0):
        super().__init__()
        self._setDefault(objective="binary:logistic", zeroAsMissing=False, base=[0.0], numFeatures=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.nodes: pa.Table | None = None
        self._shared = None

    def with_nodes(self, nodes: pa.Table) -> HistBoostModel:
        self.nodes, self._shared = nodes, None
        return self

    def copy(self, extra=None):
        return super().copy(extra).with_nodes(self.nodes)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        if self._shared is None:
            self._shared = dataset.sparkSession.sparkContext.broadcast(Forest(self.nodes, np.array(self.getOrDefault(self.base)), self.getOrDefault(self.zeroAsMissing)))
        df = dataset.withColumn("_hb_m", _margin_udf(self._shared, self.getOrDefault(self.numFeatures))(F.col(self.getOrDefault(self.featuresCol))))
        return predictions(df, "_hb_m", self.getOrDefault(self.objective), self.getOrDefault(self.predictionCol)).drop("_hb_m")


def predictions(df: DataFrame, margins: str, objective: str, out: str) -> DataFrame:
    """``df`` with the prediction (and class probabilities) of an array of margins."""
    if objective == "reg:squarederror":
        return df.withColumn(out, F.col(margins)[0])
    if objective == "binary:logistic":
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(margins)[0]))
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p1, p1))).withColumn(out, F.when(p1 > 0.5, 1.0).otherwise(0.0))
    mx = F.array_max(margins)
    ex = F.transform(margins, lambda v: F.exp(v - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    return (df.withColumn("probability", array_to_vector(F.transform(ex, lambda v: v / tot)))
            .withColumn(out, (F.array_position(margins, mx) - 1).cast("double")))


def _margin_udf(shared, n: int):
    @F.arrow_udf("array<double>")
    def margins(col: pa.Array) -> pa.Array:
        m = shared.value.margins(col, n or _width(col))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
    return margins


class _ModelWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.sparkSession.createDataFrame(self.instance.nodes, NODES).write.parquet(f"{path}/nodes")


class _ModelReader(DefaultParamsReader):
    def load(self, path: str) -> HistBoostModel:
        return super().load(path).with_nodes(self.sparkSession.read.schema(NODES).parquet(f"{path}/nodes").toArrow())


def xgboost_like(objective: str, max_depth: int = 6, **kw) -> HistBoost:
    """T9-T11 defaults: zero is missing, depth-wise growth."""
    params = dict(objective=objective, maxDepth=max_depth, zeroAsMissing=True, growth="depth")
    params.update(kw)
    return HistBoost(**params)


def lightgbm_like(objective: str, **kw) -> HistBoost:
    """T12-T14 defaults: leaf-wise growth, 31 leaves of 20 rows at least, rate 0.1, no start from the average."""
    params = dict(objective=objective, growth="leaf", numLeaves=31, maxDepth=-1, eta=0.1,
                  minChildWeight=1e-3, regLambda=0.0, boostFromAverage=False, minDataInLeaf=20)
    params.update(kw)
    return HistBoost(**params)

"""Logistic models (C1-C11): own L-BFGS, mini-batch SGD and parallel local SGD, plus pyspark.ml.

Parameterization: binary ``w`` (n,) with y in {0,1}; multinomial ``W`` ((K-1), n) with class 0 as
the pivot (margin 0), as in the mllib formulation.  A constant feature (appended bias, P10)
is an ordinary, *penalized* weight -- the reason ``ml.LogisticRegression`` cannot stand in
for C1.

Objective for a batch of m rows:  (1/m) sum_i loss_i + (reg/2) ||w||^2.

Every function evaluation is one Spark pass over the persisted rows; only the n (or
(K-1) n) gradient sums and two scalars come back.  Binary passes with n <= 24 are unrolled
Column aggregates (codegen); multinomial and wide passes use a per-partition numpy kernel.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vec import dot_lit
from ..session import spread
from .linalg import _batch_matrix, _batch_vector, sum_partials

_PARTIAL = "k long, v double"
DRAW_PARTS = 1 << 20
# numbers in a block of rows
BLOCK_NUMBERS = 1 << 16
# workers of parallel SGD: part of the model's definition, not of the cluster's
WORKERS = 8


def _softplus(m: Column) -> Column:
    return F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))


def _sigmoid(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def check_labels(y: np.ndarray, num_classes: int) -> None:
    """Labels must be whole numbers in 0..num_classes-1 (P7 / P13 bring others into this form)."""
    if len(y) and not (np.isfinite(y).all() and (y == np.floor(y)).all() and y.min() >= 0 and y.max() < num_classes):
        raise ValueError(f"labels must be 0..{num_classes - 1}; map them with labels_to_01 or label_indexer first")


def _np_multinomial(A: np.ndarray, y: np.ndarray, W: np.ndarray):
    """Loss sum and gradient sum for the pivot-0 softmax; W is (K-1, n)."""
    M = A @ W.T                                   # (rows, K-1)
    full = np.concatenate([np.zeros((A.shape[0], 1)), M], axis=1)
    mx = full.max(axis=1, keepdims=True)
    e = np.exp(full - mx)
    s = e.sum(axis=1, keepdims=True)
    lse = (mx + np.log(s)).ravel()
    yi = y.astype(np.int64)
    loss = float(np.sum(lse - full[np.arange(len(yi)), yi]))
    P = e[:, 1:] / s
    onehot = np.zeros_like(P)
    mask = yi > 0
    onehot[np.arange(len(yi))[mask], yi[mask] - 1] = 1.0
    G = (P - onehot).T @ A                        # (K-1, n)
    return loss, G


def _np_binary(A, y, w):
    m = A @ w
    loss = float(np.sum(np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y * m))
    p = 1.0 / (1.0 + np.exp(-m))
    return loss, (p - y) @ A


class LossGradPass:
    """Distributed (loss_sum, grad_sum, count) for fixed weights, one Spark job per call."""

    def __init__(self, df: DataFrame, n: int, num_classes: int = 2, features: str = "features",
                 label: str = "label", method: str = "auto", persist: bool = True, carry: list[str] = ()):
        self.df = df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"), *carry)
        if persist:
            self.df = spread(self.df).persist(StorageLevel.MEMORY_AND_DISK)
        self.n, self.K = n, num_classes
        self.nparts = self.df.rdd.getNumPartitions()
        if method == "auto":
            # iterative passes change the weights every call: inlined literals would recompile the
            # generated code each time, so the Arrow kernel (broadcast weights) is the default.
            method = "arrow"
        self.method = method
        self.evals = 0

    def close(self):
        self.df.unpersist()

    def __call__(self, W: np.ndarray, df: DataFrame | None = None):
        self.evals += 1
        src = self.df if df is None else df
        if self.method == "jvm":
            return self._jvm(src, W)
        return self._arrow(src, W)

    def _jvm(self, src, w):
        m = dot_lit("features", w)
        f = F.col("features")
        s = src.select("features", "label", m.alias("m"))
        mm, y = F.col("m"), F.col("label")
        s = s.withColumn("label", F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit("labels must be 0 or 1"))))
        r = s.agg(F.sum(_softplus(mm) - y * mm).alias("loss"), F.count(F.lit(1)).alias("cnt"),
                  *[F.sum((_sigmoid(mm) - y) * f[j]).alias(f"g{j}") for j in range(self.n)]).first()
        g = np.array([r[f"g{j}"] or 0.0 for j in range(self.n)])
        return float(r["loss"] or 0.0), g, int(r["cnt"])

    def _arrow(self, src, W):
        n, K = self.n, self.K
        sc = src.sparkSession.sparkContext
        bw = sc.broadcast(np.asarray(W, float))

        def kernel(batches):
            Wl = bw.value
            loss, cnt = 0.0, 0
            G = np.zeros_like(Wl)
            for b in batches:
                if b.num_rows == 0:
                    continue
                A = _batch_matrix(b, "features", n)
                y = _batch_vector(b, "label")
                check_labels(y, K)
                if K == 2:
                    l_, g_ = _np_binary(A, y, Wl)
                else:
                    l_, g_ = _np_multinomial(A, y, Wl)
                loss += l_
                G += g_
                cnt += b.num_rows
            v = np.concatenate([G.ravel(), [loss, float(cnt)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int64)), pa.array(v)],
                                             names=["k", "v"])
        size = int(np.prod(np.shape(W)))
        try:
            flat = sum_partials(src.mapInArrow(kernel, _PARTIAL), size + 2, self.nparts)
        finally:
            bw.destroy()
        return float(flat[size]), flat[:size].reshape(np.shape(W)), int(round(flat[size + 1]))


@dataclass
class FitResult:
    weights: np.ndarray
    history: list[float] = field(default_factory=list)
    iterations: int = 0
    evaluations: int = 0

    def weights_df(self, spark: SparkSession) -> DataFrame:
        W = np.atleast_2d(self.weights)
        rows = [(int(k), int(j), float(W[k, j])) for k in range(W.shape[0]) for j in range(W.shape[1])]
        schema = T.StructType([T.StructField("class", T.IntegerType()), T.StructField("feat_id", T.IntegerType()),
                               T.StructField("weight", T.DoubleType())])
        return spark.createDataFrame(rows, schema)

    def history_df(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("iter", T.IntegerType()), T.StructField("objective", T.DoubleType())])
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.history)], schema)


def _objective(pass_fn, reg):
    def f(w):
        loss, g, cnt = pass_fn(w)
        cnt = max(cnt, 1)
        return loss / cnt + 0.5 * reg * float(np.sum(w * w)), g / cnt + reg * w
    return f


def lbfgs(fun, w0: np.ndarray, corrections: int = 10, tol: float = 1e-5, maxit: int = 100,
          c1: float = 1e-4) -> FitResult:
    """Driver-side L-BFGS (two-loop recursion, Armijo backtracking); ``fun(w) -> (f, grad)``."""
    shape = np.shape(w0)
    w = np.asarray(w0, float).ravel()
    f, g = fun(w.reshape(shape))
    g = g.ravel()
    hist = [f]
    S, Y = deque(maxlen=corrections), deque(maxlen=corrections)
    evals, k = 1, 0
    for k in range(1, maxit + 1):
        q = g.copy()
        alphas = []
        for s, y in reversed(list(zip(S, Y))):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if S:
            q *= (S[-1] @ Y[-1]) / (Y[-1] @ Y[-1])
        for (s, y), a in zip(zip(S, Y), reversed(alphas)):
            b = (y @ q) / (y @ s)
            q += (a - b) * s
        d = -q
        gd = float(g @ d)
        if gd >= 0:
            d, gd = -g, -float(g @ g)
            S.clear(), Y.clear()
        step = 1.0 if S else min(1.0, 1.0 / max(float(np.linalg.norm(g)), 1e-12))
        while True:
            w_new = w + step * d
            f_new, g_new = fun(w_new.reshape(shape))
            g_new = g_new.ravel()
            evals += 1
            if f_new <= f + c1 * step * gd or step < 1e-12:
                break
            step *= 0.5
        s, y = w_new - w, g_new - g
        if float(s @ y) > 1e-12:
            S.append(s), Y.append(y)
        rel = abs(f - f_new) / max(abs(f_new), 1.0)
        w, f, g = w_new, f_new, g_new
        hist.append(f)
        if rel < tol or float(np.linalg.norm(g)) < 1e-12:
            break
    return FitResult(w.reshape(shape), hist, k, evals)


def fit_lbfgs(df: DataFrame, n: int, num_classes: int = 2, reg: float = 0.1, corrections: int = 10,
              tol: float = 1e-5, maxit: int = 100, features: str = "features", label: str = "label") -> FitResult:
    """C1 (binary) / multinomial variant: L2 on every weight, including an appended bias."""
    p = LossGradPass(df, n, num_classes, features, label)
    try:
        w0 = np.zeros(n) if num_classes == 2 else np.zeros((num_classes - 1, n))
        return lbfgs(_objective(p, reg), w0, corrections, tol, maxit)
    finally:
        p.close()


def fit_minibatch_sgd(df: DataFrame, n: int, num_classes: int, step_size: float = 10.0, iters: int = 200,
                      reg: float = 1e-3, fraction: float = 0.01, tol: float = 1e-5, seed: int = 42,
                      features: str = "features", label: str = "label", key: str | None = None) -> FitResult:
    """Each iteration draws ``fraction`` of the rows (seed + i), takes one gradient step
    with step ``step_size / sqrt(i)`` and the L2 shrink; stops when the relative weight change < tol.

    Rows are drawn by a hash of ``key`` (of the whole row without one), so the draw does not depend on how
    the table is laid out; an empty draw is a step by the shrink alone."""
    of = [F.col(key)] if key else [F.col(features), F.col(label)]
    p = LossGradPass(df.withColumn("_draw", F.xxhash64(*of)), n, num_classes, features, label, carry=["_draw"])
    W = np.zeros(n) if num_classes == 2 else np.zeros((num_classes - 1, n))
    hist = []
    i = 0
    try:
        for i in range(1, iters + 1):
            drawn = F.pmod(F.xxhash64("_draw", F.lit(seed + i)), F.lit(DRAW_PARTS)) < int(round(fraction * DRAW_PARTS))
            loss, g, cnt = p(W, p.df.where(drawn))
            hist.append(loss / max(cnt, 1) + 0.5 * reg * float(np.sum(W * W)))
            eta = step_size / math.sqrt(i)
            W_new = W * (1.0 - eta * reg) - eta * (g / max(cnt, 1))
            change = float(np.linalg.norm(W_new - W))
            W = W_new
            if change < tol * max(float(np.linalg.norm(W)), 1.0):
                break
    finally:
        p.close()
    return FitResult(W, hist, i, p.evals)


def worker_blocks(src: DataFrame, n: int, num_classes: int, workers: int) -> DataFrame:
    """[_worker, label, features]: the rows [features, label, _order, _worker] of each worker by ``_order``, many to a block.

    Rows are put in order in as many ranges as a shuffle has partitions, and each range is packed into blocks of numbers; only
    blocks are brought together by worker, so no task sorts a worker's rows and a pass reads plain numbers.
    """
    spark = src.sparkSession
    keys = ["_worker", "_order", "label", "features"]
    ranges = max(workers, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = max(1, BLOCK_NUMBERS // (n + 1))

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            whose = b.column(0).to_numpy()
            A, y = _batch_matrix(b, "features", n), _batch_vector(b, "label")
            check_labels(y, num_classes)
            for lo, hi in zip(cuts := np.r_[0, np.flatnonzero(np.diff(whose)) + 1].tolist(), [*cuts[1:], len(whose)], strict=True):
                for at in range(lo, hi, most):
                    end = min(at + most, hi)
                    yield pa.RecordBatch.from_arrays([pa.array([int(whose[at])], pa.int32()), pa.array([part], pa.int32()), pa.array([seq], pa.int64()),
                                                      pa.array([y[at:end].tobytes()], pa.binary()), pa.array([A[at:end].tobytes()], pa.binary())], names=["_worker", "part", "seq", "label", "features"])
                    seq += 1

    # the ranges ascend with their number; a set number of partitions stays as it is
    ordered = src.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("_worker", "label", "features")
    packed = ordered.mapInArrow(run, "_worker int, part int, seq long, label binary, features binary")
    # with more ranges than workers every worker is a range of its own
    return packed.repartitionByRange(4 * workers, "_worker").sortWithinPartitions("_worker", "part", "seq").select("_worker", "label", "features")


def fit_parallel_sgd(df: DataFrame, n: int, num_classes: int = 2, epochs: int = 100, step_size: float = 1.0,
                     reg: float = 0.0, batch: int = 64, key: str | None = None, workers: int = WORKERS,
                     features: str = "features", label: str = "label") -> FitResult:
    """Per epoch each of ``workers`` workers runs local mini-batch SGD from the broadcast weights over
    its rows, and the driver averages the local weights weighted by row counts.

    Rows go to workers, and are ordered within them, by a hash of ``key`` (of the whole row without one);
    batches run across the Arrow batches of a worker.  So the model depends on the data and ``workers`` only,
    not on files, cores or Arrow's batch size.  Give large data more workers.
    """
    spark = df.sparkSession
    src = df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"),
                    F.xxhash64(*([key] if key else [features, label])).alias("_order"))
    # the same worker for a row at any parallelism
    src = src.withColumn("_worker", F.pmod("_order", F.lit(workers)).cast("int"))
    src = worker_blocks(src, n, num_classes, workers).persist(StorageLevel.MEMORY_AND_DISK)
    K = num_classes
    W = np.zeros(n) if K == 2 else np.zeros((K - 1, n))
    nparts = src.rdd.getNumPartitions()
    hist = []
    try:
        for ep in range(1, epochs + 1):
            bw = spark.sparkContext.broadcast(W)
            eta0 = step_size / math.sqrt(ep)

            def kernel(batches, bw=bw, eta0=eta0):
                out, w, cnt, loss, worker = [], None, 0, 0.0, None
                A, y = np.zeros((0, n)), np.zeros(0)

                def steps(last=False):
                    """The local steps over all whole batches at hand, and over what is left at the worker's end."""
                    nonlocal w, cnt, loss, A, y
                    done = len(y) if last else len(y) - len(y) % batch
                    m = np.empty(done)
                    for lo in range(0, done, batch):
                        Ab, yb = A[lo:min(lo + batch, done)], y[lo:min(lo + batch, done)]
                        if K == 2:
                            m[lo:lo + len(yb)] = mb = Ab @ w
                            gb = (1.0 / (1.0 + np.exp(-mb)) - yb) @ Ab
                        else:
                            lb, gb = _np_multinomial(Ab, yb, w)
                            loss += lb
                        w = w - eta0 * (gb / len(yb) + reg * w)
                    if K == 2:
                        loss += float(np.sum(np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y[:done] * m))
                    cnt += done
                    A, y = A[done:], y[done:]

                def finish():
                    if worker is not None:
                        steps(last=True)
                        out.append(np.concatenate([(w * cnt).ravel(), [float(cnt), loss]]))

                for b in batches:
                    for whose, label_bytes, feature_bytes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                        # a partition may hold several workers' rows, one after the other
                        if whose != worker:
                            finish()
                            worker, w, cnt, loss = whose, bw.value.copy(), 0, 0.0
                            A, y = np.zeros((0, n)), np.zeros(0)
                        A = np.concatenate([A, np.frombuffer(feature_bytes.as_buffer()).reshape(-1, n)])
                        y = np.concatenate([y, np.frombuffer(label_bytes.as_buffer())])
                        steps()
                finish()
                v = np.sum(out, axis=0) if out else np.zeros(bw.value.size + 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int64)), pa.array(v)],
                                                 names=["k", "v"])
            size = W.size
            try:
                flat = sum_partials(src.mapInArrow(kernel, _PARTIAL), size + 2, nparts)
            finally:
                bw.destroy()
            cnt = max(flat[size], 1.0)
            W = (flat[:size] / cnt).reshape(W.shape)
            hist.append(flat[size + 1] / cnt)
    finally:
        src.unpersist()
    return FitResult(W, hist, epochs, epochs)


# ---------------------------------------------------------------- prediction
def predict_score(features, w, intercept: float = 0.0) -> Column:
    """sigma(w.x + b) with the threshold cleared."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot_lit(features, w) + F.lit(float(intercept)))))


def predict_class(features, W) -> Column:
    """Argmax over [0, w_1.x, ..., w_{K-1}.x] (pivot class 0); ties -> lowest class."""
    margins = F.array(F.lit(0.0), *[dot_lit(features, row) for row in np.atleast_2d(W)])
    return (F.array_position(margins, F.array_max(margins)) - 1).cast("double")


def predict_linear(features, x) -> Column:
    """C11: a.x."""
    return dot_lit(features, x)


# ---------------------------------------------------------------- pyspark.ml learners
def elastic_net(family: str = "binomial", max_iter: int = 10, reg: float = 0.3, en: float = 0.8,
                fit_intercept: bool = True) -> LogisticRegression:
    return LogisticRegression(maxIter=max_iter, regParam=reg, elasticNetParam=en, family=family,
                              fitIntercept=fit_intercept)


def multinomial_lbfgs(max_iter: int = 100) -> LogisticRegression:
    """Multinomial L-BFGS without intercept or regularization."""
    return LogisticRegression(family="multinomial", fitIntercept=False, regParam=0.0, maxIter=max_iter)


def coefficient_report(spark: SparkSession, model) -> DataFrame:
    """``[class, feat_id, weight]`` plus intercept rows (feat_id = -1)."""
    rows = []
    if model.numClasses > 2 or getattr(model, "getFamily", lambda: "")() == "multinomial":
        M = model.coefficientMatrix.toArray()
        b = model.interceptVector.toArray()
        for k in range(M.shape[0]):
            rows += [(k, j, float(M[k, j])) for j in range(M.shape[1])] + [(k, -1, float(b[k]))]
    else:
        c = model.coefficients.toArray()
        rows = [(0, j, float(v)) for j, v in enumerate(c)] + [(0, -1, float(model.intercept))]
    schema = T.StructType([T.StructField("class", T.IntegerType()), T.StructField("feat_id", T.IntegerType()),
                           T.StructField("weight", T.DoubleType())])
    return spark.createDataFrame(rows, schema)

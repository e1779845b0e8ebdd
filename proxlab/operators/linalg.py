"""Linear-algebra passes over a row-layout design matrix and its COO column layout.

Row layout:    DataFrame[..., label: double, features: array<double>]   (one row per sample)
Column layout: DataFrame[<row id cols>, feat_id: int, value: double]    (COO, zeros dropped)

Every solver in :mod:`proxlab.operators.solvers` only needs products ``G v = A^T (A v)``
plus ``c = A^T b``, ``b.b`` and ``m``.  Three operators provide them:

* :class:`GramOperator`  one Spark pass builds ``G`` (n x n); iterations then run on the driver
  in n dimensions.  Chosen when ``n <= GRAM_MAX_FEATURES``.
* :class:`RowPassOperator`  one fused Spark pass per product (per row ``r = a.v``, then
  ``sum r a``); partial sums are combined map-side, only n numbers reach the driver.
* :class:`CooOperator`  column layout: ``A v`` by joining the COO entries with ``v`` and
  grouping by row id, then ``A^T r`` by joining back and grouping by ``feat_id``.

Nothing of length m is ever collected; only n-vectors and scalars cross to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark import StorageLevel

from ..functions.vec import dot_lit
from ..session import partitions_for, spread

# Column-sum aggregates are unrolled (whole-stage codegen) up to this width; wider
# inputs use the Arrow/numpy per-partition kernel.
JVM_UNROLL_MAX = 24
# Largest n for which the n x n Gram matrix is built (P partitions each emit n^2 partials).
GRAM_MAX_FEATURES = 512
# Largest n-vector joined with a broadcast hint in the column layout (rows, ~16 bytes each).
BROADCAST_MAX_FEATURES = 2_000_000
# size of one COO entry with its row id, for partition counts
ENTRY_BYTES = 48
# numbers in a packed block of rows
BLOCK_NUMBERS = 1 << 17


@dataclass(frozen=True)
class Shape:
    m: int
    n: int


def as_double_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Cast an array<float|int> feature column to array<double> once, at ingest."""
    dt = df.schema[features].dataType
    if isinstance(dt, T.ArrayType) and not isinstance(dt.elementType, T.DoubleType):
        return df.withColumn(features, F.transform(F.col(features), lambda v: v.cast("double")))
    return df


def shape(df: DataFrame, features: str = "features") -> Shape:
    """Rows and width in one aggregation; unequal widths raise."""
    r = df.agg(F.count(F.lit(1)).alias("m"), F.min(F.size(features)).alias("lo"),
               F.max(F.size(features)).alias("hi")).first()
    if r["m"] == 0:
        raise ValueError("empty design matrix")
    if r["lo"] != r["hi"]:
        raise ValueError(f"rows have unequal feature widths ({r['lo']} vs {r['hi']})")
    return Shape(int(r["m"]), int(r["hi"]))


# ---------------------------------------------------------------- Gram / moment pass

@dataclass
class Moments:
    """G = A^T A (None if not requested), c = A^T b, bb = b.b, m, trace(G) = sum ||a_i||^2."""
    G: np.ndarray | None
    c: np.ndarray
    bb: float
    m: int
    trace: float

    @property
    def n(self) -> int:
        return len(self.c)


def _moments_jvm(df: DataFrame, n: int, features: str, label: str, with_gram: bool) -> Moments:
    f, b = F.col(features), F.col(label)
    exprs = []
    if with_gram:
        exprs += [F.sum(f[i] * f[j]).alias(f"g_{i}_{j}") for i in range(n) for j in range(i, n)]
    exprs += [F.sum(f[j] * b).alias(f"c_{j}") for j in range(n)]
    exprs += [F.sum(b * b).alias("bb"), F.count(F.lit(1)).alias("m"),
              F.sum(sum((f[j] * f[j] for j in range(n)), F.lit(0.0))).alias("tr"),
              F.sum(F.when(bad_row(f, n), 1).otherwise(0)).alias("bad")]
    r = df.agg(*exprs).first().asDict()
    if r["bad"]:
        raise ValueError(f"{r['bad']} rows have no feature vector of {n} numbers")
    G = None
    if with_gram:
        G = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                G[i, j] = G[j, i] = r[f"g_{i}_{j}"] or 0.0
    c = np.array([r[f"c_{j}"] or 0.0 for j in range(n)])
    return Moments(G, c, float(r["bb"] or 0.0), int(r["m"]), float(r["tr"] or 0.0))


def bad_row(f, n: int):
    """Null vectors, vectors of another width, and null elements are errors in every path."""
    bad = f.isNull() | (F.size(f) != n)
    for j in range(n):
        bad = bad | F.get(f, F.lit(j)).isNull()
    return bad


def _batch_matrix(batch: pa.RecordBatch, features: str, n: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(features))
    if len(col) and (col.null_count or col.flatten().null_count or pc.any(pc.not_equal(pc.list_value_length(col), n)).as_py()):
        raise ValueError(f"some rows have no feature vector of {n} numbers")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(-1, n) if len(col) else np.zeros((0, n))


def _batch_vector(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.float64)


_PARTIAL_SCHEMA = "k long, v double"
# partitions x partial-vector length below which per-partition partials are collected as they
# are (one stage); above it they are first summed by key in a grouped shuffle
DIRECT_COLLECT_MAX = 4_000_000


def sum_partials(partials: DataFrame, size: int, nparts: int) -> np.ndarray:
    """Sum long-format ``[k, v]`` partials (one vector per partition) into a dense vector."""
    if nparts * size > DIRECT_COLLECT_MAX:
        partials = partials.groupBy("k").agg(F.sum("v").alias("v"))
    tbl = partials.toArrow()
    if tbl.num_rows == 0:
        return np.zeros(size)
    return np.bincount(tbl.column("k").to_numpy(), weights=tbl.column("v").to_numpy(), minlength=size)


def _moments_arrow(df: DataFrame, n: int, features: str, label: str, with_gram: bool) -> Moments:
    """Per-partition numpy accumulation (F^T F per Arrow batch), long-format partials summed by key."""
    def kernel(batches):
        G = np.zeros((n, n)) if with_gram else None
        c = np.zeros(n)
        bb = tr = 0.0
        m = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            A = _batch_matrix(batch, features, n)
            b = _batch_vector(batch, label)
            if with_gram:
                G += A.T @ A
            c += A.T @ b
            bb += float(b @ b)
            tr += float(np.einsum("ij,ij->", A, A))
            m += batch.num_rows
        vals = [] if G is None else [G.ravel()]
        vals += [c, np.array([bb, float(m), tr])]
        v = np.concatenate(vals)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int64)), pa.array(v)],
                                         names=["k", "v"])

    src = df.select(features, label)
    flat = sum_partials(src.mapInArrow(kernel, _PARTIAL_SCHEMA), (n * n if with_gram else 0) + n + 3,
                        src.rdd.getNumPartitions())
    off = 0
    G = None
    if with_gram:
        G = flat[: n * n].reshape(n, n)
        off = n * n
    c = flat[off: off + n]
    bb, m, tr = flat[off + n: off + n + 3]
    return Moments(G, c, float(bb), int(round(m)), float(tr))


def moments(df: DataFrame, n: int, features: str = "features", label: str = "label",
            with_gram: bool = True, method: str = "auto") -> Moments:
    """One pass: Gram matrix (optional), A^T b, b.b, m and trace(A^T A)."""
    if with_gram and n > GRAM_MAX_FEATURES:
        raise ValueError(f"n={n} exceeds GRAM_MAX_FEATURES={GRAM_MAX_FEATURES}; use a pass operator")
    if method == "auto":
        method = "jvm" if n <= JVM_UNROLL_MAX else "arrow"
    if method == "jvm":
        return _moments_jvm(df, n, features, label, with_gram)
    if method == "arrow":
        return _moments_arrow(df, n, features, label, with_gram)
    raise ValueError(f"unknown method {method!r}")


def packed_rows(df: DataFrame, n: int, features: str = "features") -> DataFrame:
    """[block]: the feature vectors as blocks of numbers (row after row, 8 bytes each), which a pass reads as they are.

    Every vector has ``n`` numbers; up to ``JVM_UNROLL_MAX`` they go to Python as plain columns, not as one list per row.
    """
    most = max(1, BLOCK_NUMBERS // n)
    f, flat = F.col(features), n <= JVM_UNROLL_MAX

    def run(batches):
        held, rows = [], 0
        for b in batches:
            A = np.column_stack([_batch_vector(b, f"f{j}") for j in range(n)]) if flat else _batch_matrix(b, features, n)
            for lo in range(0, len(A), most):
                held.append(A[lo:lo + most])
                rows += len(held[-1])
                if rows >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block"])
                    held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block"])

    src = df.select(*[F.get(f, F.lit(j)).cast("double").alias(f"f{j}") for j in range(n)]) if flat else df.select(f)
    return src.mapInArrow(run, "block binary")


# ---------------------------------------------------------------- G.v operators

class Residual:
    """||A x - b||^2 as a sum of squares, in one pass (no cancellation)."""

    def residual_sq(self, x: np.ndarray) -> float:
        if self.n <= JVM_UNROLL_MAX:
            r = dot_lit(self.features, x) - F.col(self.label)
            return float(self.df.agg(F.sum(r * r).alias("r2")).first()["r2"] or 0.0)
        # one literal per feature would make the plan grow with n: the vector is broadcast instead
        n, features, label = self.n, self.features, self.label
        shared = self.df.sparkSession.sparkContext.broadcast(np.asarray(x, float))

        def kernel(batches):
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    r = _batch_matrix(batch, features, n) @ shared.value - _batch_vector(batch, label)
                    total += float(r @ r)
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["r2"])

        out = self.df.select(features, label).mapInArrow(kernel, "r2 double").agg(F.sum("r2")).first()[0]
        shared.destroy()
        return float(out or 0.0)


class GramOperator(Residual):
    """G.v on the driver from a once-built Gram matrix."""

    kind = "gram"

    def __init__(self, df: DataFrame, n: int, features: str = "features", label: str = "label",
                 method: str = "auto"):
        self.df, self.features, self.label = df, features, label
        mo = moments(df, n, features, label, with_gram=True, method=method)
        self.G, self.c, self.bb, self.m, self.trace, self.n = mo.G, mo.c, mo.bb, mo.m, mo.trace, n
        self.passes = 1

    def gv(self, v: np.ndarray) -> np.ndarray:
        return self.G @ v

    def close(self):
        pass


class RowPassOperator(Residual):
    """G.v = A^T (A v) by one fused Spark pass over the rows, persisted as blocks of numbers.

    ``method="jvm"`` keeps the rows as they are and sums columns; it recompiles its code for every product.
    """

    kind = "pass"

    def __init__(self, df: DataFrame, n: int, features: str = "features", label: str = "label",
                 method: str = "auto"):
        self.df = df.select(features, label)
        self.features, self.label, self.n = features, label, n
        self.method = method if method != "auto" else "arrow"
        if self.method == "jvm":
            self.df = self.rows = spread(self.df).persist(StorageLevel.MEMORY_AND_DISK)
        # the moments refuse vectors of another width and nulls
        mo = moments(self.df, n, features, label, with_gram=False,
                     method="jvm" if n <= JVM_UNROLL_MAX else "arrow")
        self.c, self.bb, self.m, self.trace = mo.c, mo.bb, mo.m, mo.trace
        if self.method != "jvm":
            # as many tasks as the numbers warrant, up to the cores
            want = min(partitions_for(df.sparkSession, self.m * n * 8), df.sparkSession.sparkContext.defaultParallelism)
            source = self.df if self.df.rdd.getNumPartitions() >= want else self.df.repartition(want)
            self.rows = packed_rows(source, n, features).persist(StorageLevel.MEMORY_AND_DISK)
        self.nparts = self.rows.rdd.getNumPartitions()
        self.passes = 1

    def gv(self, v: np.ndarray) -> np.ndarray:
        self.passes += 1
        v = np.asarray(v, dtype=float)
        if self.method == "jvm":
            f = F.col(self.features)
            r = (self.df.select(f.alias("f"), dot_lit(f, v).alias("r"))
                 .agg(*[F.sum(F.col("f")[j] * F.col("r")).alias(f"g{j}") for j in range(self.n)]).first())
            return np.array([r[f"g{j}"] or 0.0 for j in range(self.n)])
        sc = self.df.sparkSession.sparkContext
        bv = sc.broadcast(v)
        n = self.n

        def kernel(batches):
            w = bv.value
            acc = np.zeros(n)
            for batch in batches:
                for block in batch.column(0):
                    A = np.frombuffer(block.as_buffer()).reshape(-1, n)
                    acc += A.T @ (A @ w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64)), pa.array(acc)],
                                             names=["k", "v"])
        try:
            return sum_partials(self.rows.mapInArrow(kernel, _PARTIAL_SCHEMA), n, self.nparts)
        finally:
            bv.destroy()

    def close(self):
        self.rows.unpersist()


def to_coo(df: DataFrame, id_cols: list[str], features: str = "features",
           keep_zeros: bool = False) -> DataFrame:
    """Row layout -> COO ``[id_cols..., feat_id, value]``; zeros dropped unless asked."""
    coo = df.select(*id_cols, F.posexplode(features).alias("feat_id", "value"))
    coo = coo.withColumn("feat_id", F.col("feat_id").cast("int"))
    return coo if keep_zeros else coo.filter(F.col("value") != 0.0)


def vector_df(spark: SparkSession, v: np.ndarray, name: str = "weight") -> DataFrame:
    """An n-vector as ``[feat_id, <name>]`` (n rows created on the driver; n is bounded)."""
    schema = T.StructType([T.StructField("feat_id", T.IntegerType(), False),
                           T.StructField(name, T.DoubleType(), False)])
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.asarray(v, float))], schema)


def _maybe_broadcast(vdf: DataFrame, n: int) -> DataFrame:
    return F.broadcast(vdf) if n <= BROADCAST_MAX_FEATURES else vdf


def matvec_cols(coo: DataFrame, x: DataFrame, id_cols: list[str], n: int,
                weight: str = "weight", out: str = "ax", rows: DataFrame | None = None) -> DataFrame:
    """A.x in the column layout: COO join x on feat_id, grouped by row id (one shuffle on row ids).

    A row without entries (all zeros) is known only from ``rows``, the list of row ids: with it the
    result has every row.  It joins the same grouping as a zero entry, so no further shuffle is added.
    """
    terms = coo.join(_maybe_broadcast(x, n), "feat_id").select(*id_cols, (F.col("value") * F.col(weight)).alias("t"))
    if rows is not None:
        terms = terms.unionAll(rows.select(*id_cols, F.lit(0.0).alias("t")))
    return terms.groupBy(*id_cols).agg(F.sum("t").alias(out))


def rmatvec_cols(coo: DataFrame, r: DataFrame, id_cols: list[str], rcol: str = "r",
                 out: str = "grad", n: int | None = None) -> DataFrame:
    """A^T.r in the column layout: COO join r on row id, grouped by feat_id.

    With the width ``n`` features without entries appear with 0.
    """
    terms = coo.join(r, id_cols).select("feat_id", (F.col("value") * F.col(rcol)).alias("t"))
    if n is not None:
        terms = terms.unionAll(coo.sparkSession.range(n).select(F.col("id").cast("int").alias("feat_id"), F.lit(0.0).alias("t")))
    return terms.groupBy("feat_id").agg(F.sum("t").alias(out))


class CooOperator(Residual):
    """G.v = A^T (A v) in the column layout; n numbers collected per product.

    The COO entries are hash-partitioned by row id once and persisted, so every row's entries
    live in one partition.  ``product="local"`` (default) exploits that co-location: one narrow
    pass per product computes r = A v per row and scatters r a_ij into n partial sums per
    partition -- no shuffle per product.  ``product="join"`` is the declarative form: join with
    v and group by row id, then join r back and group by feature (two shuffles).
    """

    kind = "cols"

    def __init__(self, df: DataFrame, n: int, id_cols: list[str], features: str = "features",
                 label: str = "label", product: str = "local"):
        self.spark = df.sparkSession
        self.id_cols, self.n, self.product = id_cols, n, product
        self.df, self.features, self.label = df, features, label
        mo = moments(df, n, features, label, with_gram=False,
                     method="jvm" if n <= JVM_UNROLL_MAX else "arrow")
        self.c, self.bb, self.m, self.trace = mo.c, mo.bb, mo.m, mo.trace
        if df.groupBy(*id_cols).count().where("count > 1").take(1):
            raise ValueError(f"{id_cols} do not identify rows: some occur more than once")
        coo = to_coo(df, id_cols, features)
        parts = partitions_for(self.spark, mo.m * n * ENTRY_BYTES)
        # sorted by row id inside each partition: a row's entries are contiguous, so the product
        # kernel finds row boundaries with one linear scan
        self.coo = (coo.repartition(parts, *id_cols).sortWithinPartitions(*id_cols)
                    .persist(StorageLevel.MEMORY_AND_DISK))
        self.nparts = parts
        self.passes = 1

    def gv(self, v: np.ndarray) -> np.ndarray:
        self.passes += 1
        if self.product == "local":
            return self._gv_local(np.asarray(v, float))
        xdf = vector_df(self.spark, v)
        r = matvec_cols(self.coo, xdf, self.id_cols, self.n, out="r")
        rows = rmatvec_cols(self.coo, r, self.id_cols, out="g").collect()
        out = np.zeros(self.n)
        for row in rows:
            out[row["feat_id"]] = row["g"]
        return out

    def _gv_local(self, v: np.ndarray) -> np.ndarray:
        n, ids = self.n, list(self.id_cols)
        bv = self.spark.sparkContext.broadcast(v)

        def kernel(batches):
            w = bv.value
            g: dict[int, float] = {}
            held = None  # entries of the last row, which may go on in the next batch
            for b in batches:
                if b.num_rows == 0:
                    continue
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
                new = _row_starts(held, ids)
                _add_products(held.slice(0, new[-1]), new[:-1], w, g)
                held = held.slice(new[-1])
            if held is not None:
                _add_products(held, np.zeros(1, np.int64), w, g)
            yield pa.RecordBatch.from_arrays([pa.array(list(g), pa.int64()), pa.array(list(g.values()), pa.float64())], names=["k", "v"])
        try:
            return sum_partials(self.coo.mapInArrow(kernel, _PARTIAL_SCHEMA), n, self.nparts)
        finally:
            bv.destroy()

    def close(self):
        self.coo.unpersist()


def _row_starts(entries: pa.Table, ids: list[str]) -> np.ndarray:
    """Places where the row id changes (sorted entries); ids of any type are compared as they are."""
    change = np.zeros(entries.num_rows, bool)
    change[0] = True
    for c in ids:
        col = entries[c].combine_chunks()
        if entries.num_rows > 1:
            change[1:] |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _add_products(entries: pa.Table, starts: np.ndarray, w: np.ndarray, g: dict[int, float]) -> None:
    """Add A^T (A w) of whole rows to the touched features' sums."""
    if not len(starts):
        return
    feat, value = entries["feat_id"].to_numpy(), entries["value"].to_numpy()
    r = np.add.reduceat(value * w[feat], starts)
    per_entry = np.repeat(r, np.diff(np.r_[starts, len(value)]))
    touched, at = np.unique(feat, return_inverse=True)
    for f, s in zip(touched.tolist(), np.bincount(at, weights=value * per_entry).tolist(), strict=True):
        g[f] = g.get(f, 0.0) + s


def make_operator(df: DataFrame, n: int, layout: str = "rows", method: str = "auto",
                  id_cols: list[str] | None = None, features: str = "features", label: str = "label"):
    """Pick the G.v operator: rows+auto -> Gram when n is small, else one pass per product."""
    if layout == "cols":
        if not id_cols:
            raise ValueError("the column layout needs id_cols that identify a row")
        return CooOperator(df, n, id_cols, features, label)
    if layout != "rows":
        raise ValueError(f"unknown layout {layout!r}")
    if method == "auto":
        method = "gram" if n <= GRAM_MAX_FEATURES else "pass"
    if method == "gram":
        return GramOperator(df, n, features, label)
    if method == "pass":
        return RowPassOperator(df, n, features, label)
    raise ValueError(f"unknown method {method!r}")


# ---------------------------------------------------------------- row-layout kernels as DataFrames

def matvec_rows(df: DataFrame, x, features: str = "features", out: str = "ax") -> DataFrame:
    """L1: A.x, one dot per row, as a new column (codegen'd for n <= 256)."""
    return df.withColumn(out, dot_lit(features, x))


def rmatvec_rows(df: DataFrame, r_col: str, n: int, features: str = "features") -> DataFrame:
    """L3: A^T.r as ``[feat_id, value]`` (column sums, partial aggregation map-side)."""
    f = F.col(features)
    agg = df.agg(*[F.sum(f[j] * F.col(r_col)).alias(f"g{j}") for j in range(n)])
    return agg.select(F.posexplode(F.array(*[F.col(f"g{j}") for j in range(n)])).alias("feat_id", "value"))

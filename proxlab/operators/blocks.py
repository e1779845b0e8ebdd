"""Linear algebra and linearized ADMM in the column layout, with distributed n- and m-vectors.

The matrix is kept as *strips*: a strip is a non-zero part of one column within one row block,
``[rb, cb, j, idx, val]`` (row block, column block, column within its block, rows within their block).  All strips of
a pair (row block, column block) lie in one partition of the persisted frame; a pair holds at most ``row_block`` *
``col_block`` numbers, so neither a dense column (the bias, say) nor a dense row makes a hot partition.

An n-vector is a frame of one array per column block, ``[cb, rbs, ...]``, with the row blocks in which the column block
has entries; an m-vector one of one array per row block, ``[rb, cbs, ...]``.  A product ``A w`` sends each non-empty pair
its ``col_block`` numbers (the matrix stays where it is), multiplies, and sums the partial results per row block;
``A^T r`` does the same the other way.  Where each row block has a single column block, one pass over the pairs does both.
No vector, of length n or m, is ever on the driver.

:func:`admm` carries, beside x, its image ``G x = A^T A x``.  Since the multiplier and the split variable of linearized
ADMM stay of the form p = A a + gamma b, y = A d + eps b, the images of all other vectors follow by the same linear
updates as the vectors themselves, and an iteration costs one product.  The product's last sum and the updates meet in
one pass by column block, whose result is written to the shared scratch folder and read again: that cuts the lineage,
and its size is known (a checkpoint keeps the product of the plan's size estimates, whose digits double every iteration).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prox import check_penalty
from ..session import checkpoint_dir, partitions_for, scratch_path, ship_package
from .solvers import STATE, SUMS, Numbers, Updates, admm_scalars, stops, too_far, within

ROW_BLOCK, COL_BLOCK = 1 << 14, 1 << 8
ENTRY_BYTES = 12
#: bytes of strips or of a vector's blocks that a task decodes at once from a written table
READ_BYTES = 16 << 20
STRIP = "rb long, cb long, j int, idx array<int>, val array<double>"


def _flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values of a list column in one array, length of each list)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col.flatten().to_numpy(zero_copy_only=False), np.asarray(col.value_lengths())


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0)))


def array_dot(a: str, b: str) -> Column:
    """Dot product of two array columns of a row."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def summed(parts: DataFrame, partitions: int) -> DataFrame:
    """[rb, cbs, r] from [rb, cb, part]: element-wise sums per row block, holding one array at a time."""

    def out(rb, cbs, total):
        return pa.RecordBatch.from_arrays([pa.array([rb], pa.int64()), pa.array([cbs], pa.list_(pa.int64())), _lists([total])], names=["rb", "cbs", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cbs, total = None, [], None
        for batch in batches:
            flat, size = _flat(batch.column("part"))
            ends = np.cumsum(size)
            for rb, cb, lo, hi in zip(batch.column("rb").to_pylist(), batch.column("cb").to_pylist(), (ends - size).tolist(), ends.tolist(), strict=True):
                if rb == at:
                    total += flat[lo:hi]
                    cbs.append(cb)
                    continue
                if at is not None:
                    yield out(at, cbs, total)
                at, cbs, total = rb, [cb], flat[lo:hi].copy()
        if at is not None:
            yield out(at, cbs, total)

    return parts.repartition(partitions, "rb").sortWithinPartitions("rb").mapInArrow(run, "rb long, cbs array<long>, r array<double>")


def forward_kernel(j: np.ndarray, size: np.ndarray, idx: np.ndarray, val: np.ndarray, w: np.ndarray, height: int) -> np.ndarray:
    """A w of a pair's strips."""
    return np.bincount(idx, val * np.repeat(w[j], size), height)


def backward_kernel(j: np.ndarray, size: np.ndarray, idx: np.ndarray, val: np.ndarray, r: np.ndarray, width: int) -> np.ndarray:
    """A^T r of a pair's strips."""
    out, full = np.zeros(width), size > 0
    if full.any():
        np.add.at(out, j[full], np.add.reduceat(val * r[idx], (np.cumsum(size) - size)[full]))
    return out


class ColumnBlocks:
    """A matrix of ``m`` rows and ``n`` columns as written and persisted strips, with its index of non-empty pairs.

    Products are planned in a session of its own without adaptive re-planning: every product has the same
    plan, partitioned like the strips.
    """

    def __init__(self, strips: DataFrame, m: int, n: int, row_block: int, col_block: int):
        ship_package(strips.sparkSession)
        checkpoint_dir(strips.sparkSession)
        self.m, self.n, self.row_block, self.col_block = m, n, row_block, col_block
        self.spark = strips.sparkSession.newSession()
        # files hold few bits of an entry, so a reader's usual 4,096 rows are the strips of a whole file: some 800 MB a task
        self.spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(max(1, READ_BYTES // (row_block * ENTRY_BYTES))))
        path = scratch_path(self.spark, "strips")
        strips.write.parquet(path)
        written = self.spark.read.schema(strips.schema).parquet(path)
        size = written.agg(F.sum(F.size("val")).alias("entries"), F.sum(F.aggregate("val", F.lit(0.0), lambda s, v: s + v * v)).alias("trace"),
                           F.countDistinct("rb", "cb").alias("pairs"), F.countDistinct("rb").alias("rbs")).first()
        self.entries, self.trace = int(size["entries"] or 0), float(size["trace"] or 0.0)
        self.one_pass = size["pairs"] == size["rbs"]
        # one partition would count as unkeyed and be dealt anew in every product
        self.partitions = max(2, partitions_for(self.spark, self.entries * ENTRY_BYTES))
        self.spark.conf.set("spark.sql.adaptive.enabled", "false")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.partitions))
        self.strips = written.repartition(self.partitions, "rb", "cb").sortWithinPartitions("rb", "cb").persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.strips.unpersist()

    def local(self, frame: DataFrame, name: str) -> DataFrame:
        """``frame`` written and read in the matrix's session."""
        path = scratch_path(self.spark, name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _meet(self, sent: DataFrame, kernel: Callable) -> DataFrame:
        """[rb, cb, part]: ``kernel`` of the strips and of the vector's part [rb, cb, v], for every non-empty pair."""

        def run(key: tuple, strips: pa.Table, parts: pa.Table) -> pa.Table:
            rb, cb = (k.as_py() for k in key)
            idx, size = _flat(strips["idx"])
            val, _ = _flat(strips["val"])
            v, _ = _flat(parts["v"])
            part = kernel(rb, cb, strips["j"].to_numpy(), size, idx, val, v)
            return pa.table({"rb": pa.array([rb], pa.int64()), "cb": pa.array([cb], pa.int64()), "part": _lists([part])})

        to = sent.select(F.col("rb").alias("to_rb"), F.col("cb").alias("to_cb"), "v")
        return self.strips.groupBy("rb", "cb").cogroup(to.groupBy("to_rb", "to_cb")).applyInArrow(run, "rb long, cb long, part array<double>")

    def _heights(self) -> tuple[Callable[[int], int], Callable[[int], int]]:
        m, n, height, width = self.m, self.n, self.row_block, self.col_block
        return (lambda rb: min(height, m - rb * height)), (lambda cb: min(width, n - cb * width))

    def forward(self, vector: DataFrame, value: str = "w") -> DataFrame:
        """A w as [rb, cbs, r] from [cb, rbs, w]; row blocks without an entry are missing."""
        rows, _ = self._heights()
        sent = vector.select(F.explode("rbs").alias("rb"), "cb", F.col(value).alias("v"))
        return summed(self._meet(sent, lambda rb, cb, j, size, idx, val, w: forward_kernel(j, size, idx, val, w, rows(rb))), self.partitions)

    def backward_parts(self, vector: DataFrame, value: str = "r") -> DataFrame:
        """[rb, cb, part], whose sums per column block are A^T r, from [rb, cbs, r]."""
        _, columns = self._heights()
        sent = vector.select("rb", F.explode("cbs").alias("cb"), F.col(value).alias("v"))
        return self._meet(sent, lambda rb, cb, j, size, idx, val, r: backward_kernel(j, size, idx, val, r, columns(cb)))

    def product_parts(self, vector: DataFrame, value: str = "w") -> DataFrame:
        """[rb, cb, part], whose sums per column block are A^T A w, from [cb, rbs, w]."""
        if not self.one_pass:
            return self.backward_parts(self.forward(vector, value))
        rows, columns = self._heights()

        def kernel(rb, cb, j, size, idx, val, w):
            return backward_kernel(j, size, idx, val, forward_kernel(j, size, idx, val, w, rows(rb)), columns(cb))

        return self._meet(vector.select(F.explode("rbs").alias("rb"), "cb", F.col(value).alias("v")), kernel)

    def column_blocks(self) -> DataFrame:
        """[cb, size, rbs] of all column blocks; ``rbs`` is empty where a block has no entry."""
        size = F.least(F.lit(self.col_block), F.lit(self.n) - F.col("id") * self.col_block).cast("int")
        every = self.spark.range(-(-self.n // self.col_block)).select(F.col("id").alias("of"), size.alias("size"))
        met = self.strips.groupBy("cb").agg(F.collect_set("rb").alias("rbs"))
        return every.join(met, F.col("of") == F.col("cb"), "left").select(F.col("of").alias("cb"), "size", F.coalesce("rbs", F.array().cast("array<long>")).alias("rbs"))

    def with_columns(self, vector: DataFrame) -> DataFrame:
        """[rb, cbs, ...] of an m-vector [rb, ...]: the column blocks with entries in each row block."""
        met = self.strips.groupBy("rb").agg(F.collect_set("cb").alias("cbs")).withColumnRenamed("rb", "of")
        return vector.join(met, F.col("rb") == F.col("of")).drop("of")

    def to_values(self, frame: DataFrame, **names: str) -> DataFrame:
        """[feat_id, one column per name] from a frame of arrays per column block."""
        flat = frame.select("cb", F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for n, c in names.items()])).alias("j", "v"))
        return flat.select((F.col("cb") * self.col_block + F.col("j")).cast("int").alias("feat_id"), *[F.col(f"v.{n}").alias(n) for n in names])


def from_column_lines(columns: DataFrame, row_block: int = ROW_BLOCK, col_block: int = COL_BLOCK) -> ColumnBlocks:
    """From [feat_id, features]: one line of m values per matrix column, numbered from 0 (see ``sources.text.read_indexed_lines``).

    With a column ``start`` a row is a piece of its line, from that place on (see ``sources.text.read_column_pieces``).
    Lines of unequal length, null values and gaps in the numbering or in a line are errors.
    """
    spark = columns.sparkSession
    ship_package(spark)
    columns = columns.select(F.col("feat_id").cast("long").alias("feat_id"), F.col("start").cast("long").alias("start") if "start" in columns.columns else F.lit(0).cast("long").alias("start"), "features")
    size = F.size("features")
    lines = columns.groupBy("feat_id").agg(F.sum(size).alias("k"), F.max(F.col("start") + size).alias("end"), F.min("start").alias("first"))
    shape = lines.agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("end").alias("end"), F.min("end").alias("least"),
                      F.max("first").alias("first"), F.min("feat_id").alias("low"), F.max("feat_id").alias("last")).first()
    if not shape["n"] or shape["lo"] is None or shape["lo"] < 1:
        raise ValueError("empty matrix")
    if shape["least"] != shape["end"]:
        raise ValueError(f"columns have unequal lengths ({shape['least']} vs {shape['end']})")
    if (shape["low"], shape["last"]) != (0, shape["n"] - 1) or (shape["lo"], shape["hi"], shape["first"]) != (shape["end"], shape["end"], 0):
        raise ValueError("columns must be numbered 0 .. n - 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for feat, start, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if line.values.null_count:
                    raise ValueError(f"column {feat} holds a value that is no number")
                v = line.values.to_numpy(zero_copy_only=False).astype(np.float64)
                some = np.flatnonzero(v)
                at = some + start
                rb, first = np.unique(at // row_block, return_index=True)
                ends = np.r_[first[1:], len(at)] if len(at) else first
                for b, lo, hi in zip(rb.tolist(), first.tolist(), ends.tolist(), strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int64()), pa.array([feat // col_block], pa.int64()), pa.array([feat % col_block], pa.int32()),
                         pa.array([(at[lo:hi] - b * row_block).astype(np.int32)], pa.list_(pa.int32())), pa.array([v[some[lo:hi]]], pa.list_(pa.float64()))],
                        names=["rb", "cb", "j", "idx", "val"])

    strips = columns.mapInArrow(run, STRIP)
    return ColumnBlocks(strips, int(shape["end"]), int(shape["n"]), row_block, col_block)


def from_entries(coo: DataFrame, m: int, n: int, row: str = "row_id", row_block: int = ROW_BLOCK, col_block: int = COL_BLOCK) -> ColumnBlocks:
    """From non-zero entries [row (number 0 .. m - 1), feat_id, value]; a repeated entry counts as the sum of its values."""
    r, f = F.col(row).cast("long"), F.col("feat_id").cast("long")
    rb, cb = F.floor(r / row_block).cast("long"), F.floor(f / col_block).cast("long")
    cells = coo.groupBy(r.alias("r"), f.alias("f")).agg(F.sum("value").alias("v"))
    rb, cb = F.floor(F.col("r") / row_block).cast("long"), F.floor(F.col("f") / col_block).cast("long")
    pairs = F.array_sort(F.collect_list(F.struct((F.col("r") - F.col("rb") * row_block).cast("int").alias("i"), "v")))
    strips = (cells.withColumn("rb", rb).withColumn("cb", cb).withColumn("j", (F.col("f") - F.col("cb") * col_block).cast("int"))
              .groupBy("rb", "cb", "j").agg(pairs.alias("p")).select("rb", "cb", "j", F.col("p.i").alias("idx"), F.col("p.v").alias("val")))
    return ColumnBlocks(strips, m, n, row_block, col_block)


def row_vector(values: DataFrame, m: int, row_block: int = ROW_BLOCK, index: str = "feat_id", value: str = "value", out: str = "r") -> DataFrame:
    """[rb, out] from [index (0 .. m - 1), value]; every index must occur once."""
    size = values.agg(F.count("*").alias("n"), F.countDistinct(index).alias("ids"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.count(value).alias("full")).first()
    if (size["n"], size["ids"], size["full"]) != (m, m, m) or (size["lo"], size["hi"]) != (0, m - 1):
        raise ValueError(f"the vector needs one number for each of {m} rows")
    i = F.col(index).cast("long")
    part = values.select(F.floor(i / row_block).cast("long").alias("rb"), i.alias("i"), F.col(value).cast("double").alias("v"))
    return part.groupBy("rb").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select("rb", F.col("p.v").alias(out))


# ---------------------------------------------------------------- linearized ADMM

@dataclass
class BlockResult:
    """``state`` holds x and z per column block; ``history`` the scalars of each iteration."""
    matrix: ColumnBlocks
    state: DataFrame
    step: float
    iterations: int
    history: list[dict] = field(default_factory=list)

    def weights(self) -> DataFrame:
        """[feat_id, weight, extrapolated], as distributed as the state."""
        return self.matrix.to_values(self.state, weight="x", extrapolated="z")


def _rows(table, names) -> list[dict]:
    columns = [table.column(n) for n in names]
    return [{n: c[i].values.to_numpy(zero_copy_only=False) for n, c in zip(names, columns, strict=True)} for i in range(len(columns[0]))]


def _schema(names) -> str:
    return "cb long, rbs array<long>, " + ", ".join(f"{n} array<double>" for n in names)


def _updated(state: DataFrame, given: tuple[str, ...], update: Callable[[dict], dict]) -> DataFrame:
    """[cb, rbs, STATE, w] after ``update``, one column block at a time."""
    names = (*STATE, "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [update(r) for r in _rows(batch, given)]
            yield pa.RecordBatch.from_arrays([batch.column("cb"), batch.column("rbs"), *(_lists([r[n] for r in rows]) for n in names)], names=["cb", "rbs", *names])

    return state.select("cb", "rbs", *given).mapInArrow(run, _schema(names))


def _with_sums(state: DataFrame, given: tuple[str, ...], parts: DataFrame, names: tuple[str, ...], then: Callable[[dict, np.ndarray], dict]) -> DataFrame:
    """[cb, rbs, names] from ``then`` of each block's state and the sum of its parts (zeros where it has none)."""

    def run(key: tuple, rows: pa.Table, parts: pa.Table) -> pa.Table:
        s = _rows(rows, given)[0]
        total = np.zeros(len(s[given[0]]))
        for batch in parts.to_batches():
            flat, size = _flat(batch.column("part"))
            if len(size):
                total += flat.reshape(len(size), -1).sum(axis=0)
        out = then(s, total)
        return pa.table([rows["cb"], rows["rbs"], *(_lists([np.atleast_1d(out[n])]) for n in names)], names=["cb", "rbs", *names])

    to = parts.select(F.col("cb").alias("of"), "part")
    return state.select("cb", "rbs", *given).groupBy("cb").cogroup(to.groupBy("of")).applyInArrow(run, _schema(names))


def admm(matrix: ColumnBlocks, b: DataFrame, lam: float, penalty: str = "l1", beta: float = 0.1, u: float = 1e-4, maxit: int = 80,
         tol: float = 0.0, momentum: bool = False, line_search: bool = False, shrink: float = 2.0, max_trials: int = 20) -> BlockResult:
    """Linearized ADMM (updates as in :func:`proxlab.operators.solvers.admm`) on ``matrix`` and ``b`` ([rb, r]).

    With ``tol`` it stops when |A v - y| <= tol |b| and |x - x_old| <= tol max(|x_old|, 1), both from scalar sums over the
    state.  The line search takes the product of each trial point, which is the next iteration's once accepted.
    """
    updates = Updates(check_penalty(penalty), lam, beta)
    b = matrix.local(b, "right-hand-side")
    bb = float(b.agg(F.sum(array_dot("r", "r"))).first()[0] or 0.0)
    whole = (*STATE, "w")
    ahead = admm_scalars(beta, momentum)
    weight, push, eps = next(ahead)
    at = Numbers(u, weight, push)
    empty = matrix.column_blocks().withColumn("x", F.transform(F.sequence(F.lit(1), F.col("size")), lambda _: F.lit(0.0)))
    state = _with_sums(empty, ("x",), matrix.backward_parts(matrix.with_columns(b)), whole, lambda s, c, at=at: updates.begin(c, at))
    state = matrix.local(state, "admm-state")
    watch = tol > 0 or line_search
    history: list[dict] = []
    k = 0
    for k in range(1, maxit + 1):
        weight, push, eps_next = next(ahead)
        entry: dict = {"iter": k}
        trials = 0
        while watch:
            # the state travels with the trial point's image, so that what follows needs no other table
            state = _with_sums(state, whole, matrix.product_parts(state), (*STATE, "gw", *SUMS),
                               lambda s, g, at=at: {**s, "gw": g, **updates.sums(s, g, at)})
            state = matrix.local(state, "admm-trial")
            sums = state.agg(*[F.sum(F.col(n)[0]).alias(n) for n in SUMS]).first()
            if not line_search or not too_far(sums, u):
                break
            u /= shrink
            trials += 1
            if trials >= max_trials:
                break
            at = Numbers(u, at.weight, at.push)
            state = _updated(state, STATE, lambda s, at=at: {**s, "w": updates.moved(s, at)["w"]})
        if line_search and k % 10 == 0:
            u *= 2.0
        then = Numbers(u, weight, push)
        if watch:
            state = _updated(state, (*STATE, "gw"), lambda s, at=at, then=then: updates.settled(s, s["gw"], at, then))
            entry |= stops(sums, eps, bb)
        else:
            state = _with_sums(state, whole, matrix.product_parts(state), whole, lambda s, g, at=at, then=then: updates.settled(s, g, at, then))
            state = matrix.local(state, "admm-state")
        history.append({**entry, "step": u})
        at, eps = then, eps_next
        if watch and within(entry, sums, bb, tol):
            break
    return BlockResult(matrix, state, u, k, history)

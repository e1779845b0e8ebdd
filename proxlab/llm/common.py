"""Shared helpers: shipping, Arrow text buffers, vectorized word spans and rolling hashes.

The word helpers work on one flat byte buffer per slice of texts, so the per-word cost inside a task
is a handful of numpy passes.  Texts are always whole; ``text_slices`` only groups rows so that the
working arrays of one slice stay bounded (a single text longer than the bound is a slice by itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path, ship_package

SLICE_BYTES = 1 << 20
U64 = np.uint64
MASK = (1 << 64) - 1
# odd multipliers of the two rolling hashes (any odd 64-bit numbers do)
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F


def prepare(df: DataFrame) -> DataFrame:
    """Ship the package to the workers and set the shared checkpoint folder; returns ``df``."""
    ship_package(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def column_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as the empty text."""
    arr = pc.cast(pc.fill_null(arr, ""), pa.large_binary())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return buf, offsets - offsets[0]


def text_slices(buf: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) with about ``most`` bytes in each slice."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def byte_table(separators: bytes) -> np.ndarray:
    """Boolean table of the bytes that belong to words."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: space, tab, LF, VT, FF, CR: everything else is part of a word
SPACES = byte_table(b" \t\n\x0b\x0c\r")


def word_spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per row) of all words in a flat buffer of rows."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    inside = table[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (cached per worker, doubled on demand)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.ones(size, U64)
            k = 1
            while k < size:
                p[k:2 * k] = p[:k] * U64(pow(b, k, 1 << 64))
                k *= 2
            both.append(p)
        if size > 1 << 22:  # a very long text: not kept
            return both[0], both[1]
        _POWERS[base] = have = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """64-bit hashes of ranges of a flat sequence, from one prefix sum (modulo 2**64)."""
    n = len(values)
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    return span_hashes(buf, starts, ends, base)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    up = (buf >= 65) & (buf <= 90)
    return buf + (up.astype(np.uint8) << 5)


def components(edges: DataFrame, hi: str = "a", lo: str = "b") -> DataFrame:
    """Connected components of undirected links between longs: [node, root], root the smallest node.

    Each round links every neighbour of a node, and the node, to the smallest of them, which at
    least halves path lengths in practice; rounds stop when the links form stars.  Links stay in
    Spark; each round is cut by a reliable checkpoint.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e = (edges.select(F.greatest(hi, lo).alias("u"), F.least(hi, lo).alias("v")).where("u != v").distinct()
         .checkpoint())
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = moved.unionAll(low.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
        tops = new.groupBy("u").agg(F.count("*").alias("n"))
        state = tops.agg(F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
        e = new
        if state["most"] == 1 and not new.select("v").join(tops.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").take(1):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def numbered(df: DataFrame, order: list[Column], out: str, name: str) -> tuple[DataFrame, int]:
    """(``df`` with ``out``, its rows' gapless numbers from 0 in ascending ``order``, nulls first; number of rows).

    Rows are ranged over partitions by the order, with a running number as the last key, so that equal rows, however
    many, spread over partitions; the ranged rows are written with their place, so that lost executors change no
    number.  Only the row counts of the written partitions reach the driver.
    """
    spark = df.sparkSession
    prepare(df)
    kept = df.columns
    row = df.select(F.struct(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"),
                    *[c.alias(f"k{i}") for i, c in enumerate(order)]).withColumn("tie", F.monotonically_increasing_id())
    keys = [*[f"k{i}" for i in range(len(order))], "tie"]
    ranged = row.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("place"))
    placed = saved(ranged, name).select("row", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at"))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "part long, start long")
    out_rows = placed.join(F.broadcast(starts), "part")
    return out_rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], (F.col("start") + F.col("at")).alias(out)), total

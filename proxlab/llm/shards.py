"""Sharding by a Feistel permutation of global row numbers (operator 12), with DataFrame functions only.

Rows are numbered 0 .. N - 1 in the order of their key, then of the text's crc32 and size (equal rows in any order,
which changes no row of the result).  The numbers are permuted by an alternating Feistel network over pairs
(left, right) of Z_a x Z_b with a = ceil(sqrt(N)), b = ceil(N / a): each round adds a keyed digest of one half to the
other, modulo that half's range.  Fewer than a of the pairs stand for no row; where a number lands on such a
pair, the network is applied again (cycle walking), so that the numbers 0 .. N - 1 permute among themselves.  The
permuted number p gives shard p % shards and slot p // shards: shard sizes differ by one row at most, the slots of
a shard are gapless, and the place of any row, or the row of any place, is computed from (N, shards, seed) alone
(``locate``, ``row_at``), so an interrupted reader resumes at a slot.

Plan: one range shuffle of the rows by key, whose written partitions are counted; the permutation is a
projection.  Equal texts have no influence on the place.  Rows with a null key come first in the numbering;
repeated rows are rows of their own; a null text has no bytes.  An empty table gives no rows.  Columns called
``shard``, ``slot`` or ``row_number`` are replaced, others kept.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

ROUNDS = 8
SEED = 12


def ranges(total: int) -> tuple[int, int]:
    """(a, b) with a * b >= total and fewer than a pairs to spare."""
    a = max(1, isqrt(max(0, total - 1)) + 1)
    return a, max(1, -(-total // a))


def digest(seed: int, turn: Column, half: Column) -> Column:
    """60 bits that the seed, the round and a half decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), turn, half)), 1, 15), 16, 10).cast("long")


def network(x: Column, total: int, seed: int, back: bool = False) -> Column:
    """One pass of the Feistel network over 0 .. a * b - 1, or its inverse."""
    a, b = ranges(total)
    turns = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(b if i % 2 else a).cast("long").alias("span")) for i in range(ROUNDS)]
    halves = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def forth(s: Column, t: Column) -> Column:
        return F.struct(s["r"].alias("l"), ((s["l"] + digest(seed, t["turn"], s["r"]) % t["span"]) % t["span"]).alias("r"))

    def undo(s: Column, t: Column) -> Column:
        return F.struct(F.pmod(s["r"] - digest(seed, t["turn"], s["l"]) % t["span"], t["span"]).alias("l"), s["l"].alias("r"))

    return F.aggregate(F.array(*(turns[::-1] if back else turns)), halves, undo if back else forth, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])


def walked(df: DataFrame, col: str, out: str, total: int, seed: int, back: bool = False) -> DataFrame:
    """``df`` with ``out``, the permuted ``col`` (numbers 0 .. total - 1).

    A walk meets each spare number once at most, so as many steps as there are spare numbers always suffice;
    only the rows that land on one (a share of 1 / sqrt(total) at most) take any.
    """
    a, b = ranges(total)
    first = df.withColumn(out, network(F.col(col).cast("long"), total, seed, back))
    if a * b == total:
        return first
    inside = lambda x: x < total
    on = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - total)), F.col(out),
                     lambda x, _: F.when(inside(x), x).otherwise(network(x, total, seed, back)))
    return first.withColumn(out, F.when(inside(F.col(out)), F.col(out)).otherwise(on))


def locate(df: DataFrame, row_number: str, total: int, shards: int, seed: int = SEED) -> DataFrame:
    """``df`` with shard and slot of each ``row_number``."""
    p = walked(df, row_number, "_permuted", total, seed)
    return p.withColumn("shard", (F.col("_permuted") % shards).cast("int")) \
        .withColumn("slot", ((F.col("_permuted") - F.col("shard")) / shards).cast("long")).drop("_permuted")


def row_at(df: DataFrame, shard: str, slot: str, total: int, shards: int, seed: int = SEED) -> DataFrame:
    """``df`` with row_number, the row that lies at each (shard, slot)."""
    at = df.withColumn("_permuted", F.col(slot).cast("long") * shards + F.col(shard).cast("long"))
    return walked(at, "_permuted", "row_number", total, seed, back=True).drop("_permuted")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")).cast("long"), F.lit(0).cast("long"))


def text_crc32(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("string").cast("binary")), F.lit(0).cast("long"))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", order: tuple[Column, ...] | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with row_number (from 0), shard (0 .. shards - 1) and slot (from 0 in each shard).

    ``order`` breaks ties of the key; by default the crc32 and size of ``text``, if there is such a column.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    if order is None:
        order = (text_crc32(docs["text"]), text_bytes(docs["text"])) if "text" in docs.columns else ()
    made = ("row_number", "shard", "slot")
    keys = [docs[f"`{key}`"], *order]
    rows, total = numbered(docs.drop(*[c for c in docs.columns if c.lower() in made]), keys, "row_number", "rows")
    return locate(rows, "row_number", total, shards, seed)


def write(assigned: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Parquet under ``path``/shard=S/piece=P: slots P * rows_per_file and on, in slot order.

    A piece is one task's work, whatever the size of a shard.
    """
    piece = ((F.col("slot") - F.col("slot") % rows_per_file) / rows_per_file).cast("long")
    (assigned.withColumn("piece", piece).repartition("shard", "piece").sortWithinPartitions("shard", "piece", "slot")
     .write.partitionBy("shard", "piece").parquet(path))

"""Gapless global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

PLACE_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], out: str, name: str = "numbered") -> tuple[DataFrame, int]:
    """(``df`` with ``out``, its rows' gapless numbers from 0 in ascending ``order``, nulls first; number of rows).

    Rows are ranged over partitions by the order, with a running number as the last key, so that equal rows, however
    many, spread over partitions; the ranged rows are written with their place, so that lost executors change no
    number.  Only the row counts of the written partitions reach the driver.
    """
    kept = df.columns
    row = df.select(F.struct(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"),
                    *[c.alias(f"k{i}") for i, c in enumerate(order)]).withColumn("tie", F.monotonically_increasing_id())
    keys = [*[f"k{i}" for i in range(len(order))], "tie"]
    ranged = row.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("place"))
    placed = saved(ranged, name).select("row", F.shiftright("place", PLACE_BITS).alias("part"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).alias("at"))
    starts, total = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):
        starts.append((r["part"], total))
        total += r["count"]
    begin = df.sparkSession.createDataFrame(starts, "part long, start long")
    return placed.join(F.broadcast(begin), "part").select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], (F.col("start") + F.col("at")).alias(out)), total

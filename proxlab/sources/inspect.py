"""Shape and preview (S7, S10), returned as DataFrames rather than printed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shape_df(df: DataFrame, features: str = "features") -> DataFrame:
    """One row ``[m, n_min, n_max]`` from a single aggregation (unequal widths -> n_min != n_max)."""
    return df.agg(F.count(F.lit(1)).alias("m"), F.min(F.size(features)).alias("n_min"),
                  F.max(F.size(features)).alias("n_max"))


def schema_df(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("name", T.StringType()),
                           T.StructField("type", T.StringType())])
    return spark.createDataFrame(rows, schema)


def column_stats(df: DataFrame) -> DataFrame:
    """``[name, n_null, n_distinct]`` of every column, from one pass.

    Each value becomes a (name, value) row, counted by value and then by name, so partial counts are
    made before the shuffle and no column's values meet in one task.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("s")).select("s.*")
    return cells.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.count("v").alias("n_distinct"))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)

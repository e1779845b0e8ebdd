"""Delimited files with a header (S6): explicit schema first, inference as an option."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True,
                   schema: T.StructType | str | None = None, infer: bool = True,
                   null_values: str | None = None) -> DataFrame:
    """``null_values`` (e.g. ``"NA"``) turns a text marker into a real null before typing."""
    r = spark.read.option("header", str(header).lower()).option("delimiter", sep)
    if null_values is not None:
        r = r.option("nullValue", null_values)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", "true")
    return r.csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("header", str(header).lower()).option("delimiter", sep).csv(path)

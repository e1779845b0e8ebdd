"""LibSVM (S4/S5): ``label idx:val ...`` with 1-based indices <-> ``[label, features: vector]``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None,
                as_array: bool = True) -> DataFrame:
    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", int(num_features))
    df = r.load(path)
    if as_array:
        df = df.withColumn("features", vector_to_array("features", "float64"))
    return df


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Write ``[label, features]`` (array or vector) as LibSVM text."""
    f = F.col(features)
    if dict(df.dtypes)[features].startswith("array"):
        f = array_to_vector(f)
    (df.select(F.col(label).cast("double").alias("label"), f.alias("features"))
     .write.mode("overwrite").format("libsvm").save(path))

"""The Column-expression scorers apply unchanged to a streaming DataFrame."""

from conftest import SF_SMALL
from proxlab.operators import logistic
from proxlab.plans import fixtures as fx


def test_predict_score_on_stream(spark):
    static = fx.lineitem_design(spark, SF_SMALL)
    schema = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
           .option("maxFilesPerTrigger", 1).parquet(SF_SMALL))
    from pyspark.sql import functions as F
    feats = F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0, F.lit(1.0))
    scored = src.select(logistic.predict_score(feats, [4.0, -3.0, 2.0, -1.5]).alias("score"))
    q = scored.writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    try:
        q.processAllAvailable()
        n = spark.sql("SELECT count(*) AS n FROM scored_stream").first()["n"]
    finally:
        q.stop()
    assert n == static.count()

"""Readers, writers and preparation operators."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from proxlab.operators import prep
from proxlab.session import scratch_path
from proxlab.sources import libsvm, text


def test_parse_dense_roundtrip(spark):
    lines = spark.createDataFrame([("1.5,2,3.25",), (" -1 , 0 , 4 ",)], "value string")
    out = text.parse_dense(lines).collect()
    assert out[0]["label"] == 1.5 and out[0]["features"] == [2.0, 3.25]
    assert out[1]["features"] == [0.0, 4.0]


def test_parse_dense_rejects_bad_token(spark):
    lines = spark.createDataFrame([("1,abc,3",)], "value string")
    with pytest.raises(Exception):
        text.parse_dense(lines, strict=True).collect()
    lenient = text.parse_dense(lines, strict=False)
    assert text.rejects(lenient).count() == 1


def test_vector_lines_keep_order(spark):
    from proxlab.operators.linalg import vector_df
    path = scratch_path(spark, "vec-test")
    text.write_vector_lines(vector_df(spark, [5.0, 4.0, 3.0], "value"), path)
    back = text.read_vector_lines(spark, path).orderBy("feat_id").collect()
    assert [r["value"] for r in back] == [5.0, 4.0, 3.0] and [r["feat_id"] for r in back] == [0, 1, 2]


def test_libsvm_roundtrip_zero_based(spark):
    df = spark.createDataFrame([(1.0, [0.0, 2.5, 0.0]), (0.0, [1.0, 0.0, 3.0])], "label double, features array<double>")
    path = scratch_path(spark, "libsvm-test")
    libsvm.write_libsvm(df, path)
    raw = spark.read.text(path).collect()
    line = next(r.value for r in raw if r.value.startswith("1.0"))
    assert "2:2.5" in line.split()            # 1-based on disk
    back = libsvm.read_libsvm(spark, path, num_features=3).orderBy("label").collect()
    assert back[1]["features"] == [0.0, 2.5, 0.0]


def test_column_roles_exact_vs_substring(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/customer.parquet").schema
    exact = prep.column_roles(schema, "c_name")
    assert "c_nationkey" in exact.numeric and "c_mktsegment" in exact.categorical
    sub = prep.column_roles(schema, "c_", exclude_substring=True)
    assert sub.numeric == [] and sub.categorical == []


def test_indexer_ties_alphabetical_and_null_bucket(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    m = prep.category_indexer(["v"]).fit(df)
    out = {r["v"]: r["v_idx"] for r in m.transform(df).collect()}
    assert out == {"a": 0.0, "b": 1.0, "c": 2.0, None: 3.0}


def test_normalize_zero_row_is_null(spark):
    df = spark.createDataFrame([(1.0, [0.0, 0.0]), (2.0, [3.0, 4.0])], "label double, features array<double>")
    out = prep.normalize_rows(df).orderBy("label").collect()
    assert out[0]["label"] is None and out[1]["features"] == [0.6, 0.8]


def test_binary_label_check(spark):
    ok = spark.createDataFrame([(-1.0,), (1.0,)], "label double")
    assert prep.check_binary_labels(ok) == [-1.0, 1.0]
    bad = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "label double")
    with pytest.raises(ValueError):
        prep.check_binary_labels(bad)


def test_hash_split_is_partition_independent(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    a = li.repartition(1).filter(prep.hash_split_col("l_orderkey", 60, 11)).count()
    b = li.repartition(7).filter(prep.hash_split_col("l_orderkey", 60, 11)).count()
    assert a == b and 0 < a < li.count()


def test_parse_known_width(spark):
    ok = spark.createDataFrame([("1,2,3",), ("0,0.5,-1",)], "value string")
    rows = sorted(text.parse_dense(ok, n=2).collect(), key=lambda r: r["label"])
    assert rows[0]["features"] == [0.5, -1.0] and rows[1]["label"] == 1.0
    bad = spark.createDataFrame([("1,2,3",), ("4,5",)], "value string")
    with pytest.raises(Exception):
        text.parse_dense(bad, n=2).collect()

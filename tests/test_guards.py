"""Invalid or unusual input gives an error or a whole result, never a silent wrong one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxlab import session
from proxlab.operators import linalg, metrics, prep, solvers
from proxlab.sources import text

FEATS = "id string, features array<double>, label double"


def design(spark, rows):
    return spark.createDataFrame([(str(i), f, float(b)) for i, (f, b) in enumerate(rows)], FEATS)


@pytest.mark.parametrize("method", ["jvm", "arrow"])
@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], [1.0, None], None])
def test_bad_vectors_raise_in_both_paths(spark, method, bad):
    df = design(spark, [([1.0, 2.0], 1), (bad, 1), ([3.0, 4.0], 0)])
    with pytest.raises(Exception, match="feature vector|INVALID_ARRAY_INDEX"):
        linalg.moments(df, 2, method=method)


def test_weight_zero_and_nan_follow_one_rule(spark):
    from proxlab.functions import vec
    for n in (3, 300):
        df = spark.createDataFrame([([float("nan")] + [1.0] * (n - 1),)], "f array<double>")
        w = [0.0] + [1.0] * (n - 1)
        assert np.isnan(df.select(vec.dot_lit("f", w)).first()[0])
        assert df.select(vec.dot_lit("f", w, skip_zeros=True)).first()[0] == n - 1


def test_column_layout_keeps_row_ids_apart(spark):
    rows = [(2**53, "a"), (2**53 + 1, "a"), (2**53 + 1, "b")]
    A = np.array([[1.0, 2.0], [2.0, 0.0], [0.0, 0.0]])
    df = spark.createDataFrame([(k, s, a.tolist(), 1.0) for (k, s), a in zip(rows, A)], "k long, s string, features array<double>, label double")
    v = np.array([1.0, 2.0])
    for product in ("local", "join"):
        op = linalg.CooOperator(df, 2, ["k", "s"], product=product)
        assert np.allclose(op.gv(v), A.T @ (A @ v))
        op.close()
    with pytest.raises(ValueError, match="more than once"):
        linalg.CooOperator(df, 2, ["s"])


def test_column_layout_rows_cross_arrow_batches(spark):
    rng = np.random.default_rng(0)
    A = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.7)
    df = design(spark, [(a.tolist(), 0) for a in A])
    v = rng.normal(size=5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        op = linalg.CooOperator(df, 5, ["id"])
        assert np.allclose(op.gv(v), A.T @ (A @ v))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_final_residual_does_not_cancel(spark):
    x = np.array([1000.0, -2000.0])
    A = np.random.default_rng(3).normal(size=(50, 2))
    b = A @ x + 1e-7
    df = design(spark, [(a.tolist(), v) for a, v in zip(A, b)])
    for op in (linalg.GramOperator(df, 2), linalg.CooOperator(df, 2, ["id"])):
        assert abs(op.residual_sq(x) - 50 * 1e-14) < 1e-16


@pytest.mark.parametrize("momentum", [False, True])
def test_admm_equals_the_row_level_updates(spark, momentum):
    """The collapsed recurrence against p, y and x updated row by row."""
    rng = np.random.default_rng(4)
    A, b = rng.normal(size=(30, 3)), rng.normal(size=30)
    lam, beta, u, rounds = 0.3, 0.1, 1e-2, 25
    x = z = np.zeros(3)
    p, y, t = np.zeros(30), np.zeros(30), 1.0
    for _ in range(rounds):
        v = z if momentum else x
        p = p + beta * (A @ v - y)
        y = (beta * (A @ v) + b + p) / (1 + beta)
        g = v - u * A.T @ (A @ v - y + p / beta)
        new = np.sign(g) * np.maximum(np.abs(g) - lam * u / beta, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    df = design(spark, [(a.tolist(), v) for a, v in zip(A, b)])
    got = solvers.admm(linalg.GramOperator(df, 3), lam=lam, beta=beta, u=u, maxit=rounds, momentum=momentum)
    assert np.allclose(got.x, x)


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    parts = [range(0, 2), range(2, 8), range(8, 10)]
    for i, lines in enumerate(parts):
        (tmp_path / f"part-{i:05d}.txt").write_text("".join(f"{x}\n" for x in lines))
    got = {r.feat_id: r.value for r in text.read_vector_lines(spark, str(tmp_path)).collect()}
    assert got == {i: float(i) for i in range(10)}


def test_hash_split_of_large_keys(spark):
    keys = [0, 7, 271_182, 2**31 - 1, 2 * 10**15 + 3, 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r[0] for r in df.select(prep.hash_split_col("k", 60, 11)).collect()]
    assert got == [(k * 7919 + 11) % 100 < 60 for k in keys]


def test_null_scores_raise_or_are_counted(spark):
    rows = [(0.1, 0.0), (0.9, 1.0), (None, 1.0), (float("nan"), 0.0), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, y double")
    with pytest.raises(Exception, match="null or NaN"):
        metrics.binary_points(df, "s", "y").collect()
    areas = metrics.binary_areas(metrics.binary_points(df, "s", "y", invalid="skip")).first()
    assert (areas.n_pos, areas.n_neg, areas.auc_roc) == (1, 1, 1.0)
    assert metrics.unusable_counts(df, "s", "y").first().asDict() == {"n_rows": 5, "n_bad_score": 2, "n_bad_label": 1, "n_used": 2}


def test_size_estimates_are_numbers(spark):
    df = spark.range(1000).withColumn("x", F.rand(1))
    assert session.estimated_bytes(df) >= 8000
    par = spark.sparkContext.defaultParallelism
    assert session.partitions_for(spark, 1) == 1
    assert session.partitions_for(spark, 1 << 44) == (1 << 44) // session.PARTITION_BYTES
    assert session.partitions_for(spark, 4 << 20) == min(par, 2)

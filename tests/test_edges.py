"""Edge rows from FIXTURES section 3: single row, empty partitions, x == z, unseen category."""

import numpy as np

from proxlab.operators import linalg, prep, solvers


def _design(spark, rows, parts):
    df = spark.createDataFrame(rows, "label double, features array<double>")
    return df.repartition(parts)


def test_single_row_solves(spark):
    df = _design(spark, [(2.0, [1.0, 0.5])], 1)
    op = linalg.make_operator(df, 2)
    res = solvers.fista(op, lam=0.0, penalty="l2", maxit=500, step=1.0, line_search=True)
    assert abs(float(np.array([1.0, 0.5]) @ res.x) - 2.0) < 1e-6


def test_empty_partitions_do_not_change_products(spark):
    rows = [(1.0, [1.0, 2.0]), (0.0, [0.0, 1.0]), (3.0, [2.0, 0.0])]
    many = _design(spark, rows, 8)                    # most partitions are empty
    one = _design(spark, rows, 1)
    v = np.array([0.5, -1.0])
    a = linalg.make_operator(many, 2, method="pass")
    b = linalg.make_operator(one, 2, method="gram")
    assert np.allclose(a.gv(v), b.gv(v)) and a.m == b.m == 3
    mo = linalg.moments(many, 2, method="arrow")
    assert np.allclose(mo.G, b.G) and np.allclose(mo.c, b.c)
    a.close()


def test_line_search_accepts_x_equal_z(spark):
    """A penalty so large that x stays 0 == z: d = 0 must be accepted without shrinking the step."""
    df = _design(spark, [(1.0, [1.0, 0.0]), (1.0, [0.0, 1.0])], 2)
    op = linalg.make_operator(df, 2)
    res = solvers.fista(op, lam=1e6, penalty="l1", maxit=5, step=0.5, line_search=True)
    assert np.all(res.x == 0.0) and res.step == 0.5


def test_unseen_category_goes_to_last_bucket(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    test = spark.createDataFrame([("a",), ("b",), ("zzz",), (None,)], "v string")
    m = prep.category_indexer(["v"]).fit(train)
    out = {r["v"]: r["v_idx"] for r in m.transform(test).collect()}
    assert out == {"a": 0.0, "b": 1.0, "zzz": 2.0, None: 2.0}


def test_prox_threshold_zero_is_identity():
    from proxlab.functions.prox import prox_np
    x = np.array([-3.0, 0.0, 2.5])
    assert np.allclose(prox_np("l1", x, 0.0), x) and np.allclose(prox_np("l2", x, 0.0), x)

"""Solvers: Gram == one pass per product == column layout; KKT; line-search identity; invariance."""

import numpy as np
import pytest

from conftest import SF_SMALL
from proxlab.operators import linalg, solvers
from proxlab.plans import fixtures as fx

IDS = fx.LINEITEM_IDS


@pytest.fixture(scope="module")
def design(spark):
    return fx.lineitem_design(spark, SF_SMALL).persist()


@pytest.fixture(scope="module")
def ops(design):
    g = linalg.make_operator(design, 4, method="gram")
    p = linalg.make_operator(design, 4, method="pass")
    c = linalg.make_operator(design, 4, layout="cols", id_cols=IDS)
    yield g, p, c
    p.close(), c.close()


def test_products_agree(ops, design):
    g, p, c = ops
    v = np.array([0.3, -1.0, 2.0, 0.5])
    assert np.allclose(g.gv(v), p.gv(v), rtol=1e-10)
    assert np.allclose(g.gv(v), c.gv(v), rtol=1e-10)
    j = linalg.CooOperator(design, 4, IDS, product="join")
    assert np.allclose(g.gv(v), j.gv(v), rtol=1e-10)
    j.close()
    assert np.allclose(g.c, p.c) and np.allclose(g.c, c.c)


def test_arrow_moments_equal_jvm(design):
    a = linalg.moments(design, 4, method="arrow")
    j = linalg.moments(design, 4, method="jvm")
    assert np.allclose(a.G, j.G, rtol=1e-12) and np.allclose(a.c, j.c, rtol=1e-12)
    assert a.m == j.m and abs(a.bb - j.bb) < 1e-9 * j.bb


def test_fista_methods_agree(ops):
    g, p, _ = ops
    kw = dict(lam=0.01 * g.m, penalty="l1", maxit=8, step=1.0, line_search=True)
    a, b = solvers.fista(g, **kw), solvers.fista(p, **kw)
    assert np.allclose(a.x, b.x, atol=1e-8)


@pytest.mark.parametrize("momentum,line_search", [(False, False), (True, False), (True, True)])
def test_admm_rows_equal_cols(ops, momentum, line_search):
    g, _, c = ops
    kw = dict(lam=0.01 * g.m, beta=0.1, u=1.0 / g.trace, maxit=6, momentum=momentum,
              line_search=line_search, track=False)
    assert np.allclose(solvers.admm(g, **kw).x, solvers.admm(c, **kw).x, atol=1e-8)


def test_lasso_kkt(ops):
    """At the lasso optimum |A^T(b - Ax)|_j <= lambda, with equality on the support."""
    g = ops[0]
    lam = 0.01 * g.m
    res = solvers.fista(g, lam=lam, penalty="l1", maxit=3000, step=1.0, line_search=True)
    corr = g.c - g.gv(res.x)
    for xj, cj in zip(res.x, corr):
        if abs(xj) > 1e-8:
            assert abs(cj - lam * np.sign(xj)) < 1e-3 * lam
        else:
            assert abs(cj) <= lam * (1 + 1e-3)


def test_planted_recovery_ridge(ops):
    g = ops[0]
    res = solvers.fista(g, lam=1e-6, penalty="l2", maxit=3000, step=1.0, line_search=True)
    assert np.allclose(res.x, fx.PLANT_W, atol=0.02)


def test_line_search_identity(ops):
    """||Ax-b||^2 - ||Az-b||^2 - 2 d.g == ||A d||^2 (H1)."""
    g = ops[0]
    z = np.array([0.1, 0.2, -0.3, 0.4])
    x = np.array([0.5, -0.1, 0.0, 0.2])
    r2 = lambda v: v @ g.gv(v) - 2 * g.c @ v + g.bb
    d = x - z
    grad = g.gv(z) - g.c
    assert abs((r2(x) - r2(z) - 2 * d @ grad) - d @ g.gv(d)) < 1e-8 * g.bb


def test_apg_decreases_residual(ops):
    g = ops[0]
    res = solvers.apg_restart(g, lam=0.01 * g.m, maxit=60, step=1.0 / g.trace)
    assert res.history[-1]["rel_residual"] < res.history[0]["rel_residual"]


def test_partition_invariance(spark, design):
    one = linalg.make_operator(design.coalesce(1), 4, method="pass")
    seven = linalg.make_operator(design.repartition(7), 4, method="pass")
    v = np.array([1.0, 2.0, 3.0, 4.0])
    assert np.allclose(one.gv(v), seven.gv(v), rtol=1e-10)
    one.close(), seven.close()


def test_unequal_widths_fail(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0]), (2.0, [1.0])], "label double, features array<double>")
    with pytest.raises(ValueError):
        linalg.shape(df)


def test_sparse_recovery_embeddings(spark):
    """64 features, 6 planted non-zeros: the lasso finds the support (Arrow Gram kernel)."""
    df = fx.embeddings_planted(spark, "/root/testdata/sf0.01")
    op = linalg.make_operator(df, 64)
    res = solvers.fista(op, lam=1e-3 * op.m, penalty="l1", maxit=500, step=1.0, line_search=True)
    support = {j for j, v in enumerate(res.x) if abs(v) > 0.1}
    assert set(fx.EMB_SUPPORT) <= support
    big = sorted(range(64), key=lambda j: -abs(res.x[j]))[:6]
    assert set(big) == set(fx.EMB_SUPPORT)


def test_pass_operator_packs_rows_and_agrees_with_plain_sums(spark, monkeypatch):
    """Rows are persisted as blocks of numbers (narrow and wide vectors); every product still uses every row."""
    rng = np.random.default_rng(5)
    for n in (3, linalg.JVM_UNROLL_MAX + 2):
        monkeypatch.setattr(linalg, "BLOCK_NUMBERS", 7 * n)
        A, b = rng.normal(size=(500, n)), rng.normal(size=500)
        df = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(A, b)], "features array<double>, label double").repartition(3)
        op = linalg.make_operator(df, n, method="pass")
        blocks = [np.frombuffer(r.block).reshape(-1, n) for r in op.rows.collect()]
        assert sum(map(len, blocks)) == 500 and max(map(len, blocks)) <= 14 and len(blocks) >= 36
        v = rng.normal(size=n)
        assert np.allclose(op.gv(v), A.T @ (A @ v)) and np.allclose(op.c, A.T @ b) and op.m == 500
        assert np.isclose(op.residual_sq(v), np.sum((A @ v - b) ** 2))
        op.close()

"""Proximal maps: definitions by brute-force minimization, Column form == numpy form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxlab.functions import prox

GRID = np.linspace(-12, 12, 240001)


def brute(obj):
    return GRID[np.argmin(obj(GRID))]


@pytest.mark.parametrize("v", [-7.3, -2.0, -0.4, 0.0, 0.3, 1.0, 2.5, 9.1])
@pytest.mark.parametrize("t", [0.0, 0.5, 2.0])
def test_soft_is_l1_prox(v, t):
    expect = brute(lambda x: 0.5 * (x - v) ** 2 + t * np.abs(x))
    assert abs(prox.soft_np(np.array([v]), t)[0] - expect) < 2e-4


@pytest.mark.parametrize("v", [-5.0, -1.0, 0.2, 3.0])
@pytest.mark.parametrize("t", [0.0, 0.7, 3.0])
def test_l2_is_ridge_prox(v, t):
    expect = brute(lambda x: 0.5 * (x - v) ** 2 + 0.5 * t * x * x)
    assert abs(prox.l2_np(np.array([v]), t)[0] - expect) < 2e-4


@pytest.mark.parametrize("v", [-6.0, -3.0, -1.2, 0.5, 1.5, 2.2, 4.0, 8.0])
@pytest.mark.parametrize("t", [0.5, 1.0, 2.0])
def test_half_minimizes_unhalved_objective(v, t):
    """The half-thresholding closed form minimizes (x - v)^2 + t |x|^(1/2) (scale note H6)."""
    got = prox.half_np(np.array([v]), t)[0]
    obj = lambda x: (x - v) ** 2 + t * np.sqrt(np.abs(x))
    best = brute(obj)
    assert obj(np.array([got]))[0] <= obj(np.array([best]))[0] + 1e-6 or abs(got - best) < 2e-3


def test_threshold_edge_values():
    assert prox.soft_np(np.array([2.0, -2.0]), 2.0).tolist() == [0.0, 0.0]
    assert prox.soft_np(np.array([3.0]), 0.0).tolist() == [3.0]
    assert prox.half_np(np.array([0.0]), 1.0).tolist() == [0.0]
    with pytest.raises(ValueError):
        prox.check_penalty("l3")


@pytest.mark.parametrize("penalty", ["l1", "l2", "l_half"])
def test_column_matches_numpy(spark, penalty):
    from conftest import SF_SMALL
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value")
    out = ev.select("value", prox.prox_col(penalty, F.col("value") - 100.0, 25.0).alias("p")).toPandas()
    ref = prox.prox_np(penalty, out["value"].to_numpy() - 100.0, 25.0)
    assert np.allclose(out["p"].to_numpy(), ref, rtol=1e-12, atol=1e-12)

"""Every query with a SQL oracle matches DuckDB on the smallest scale factor."""

import pytest

from conftest import SF_SMALL
from proxlab.plans.oracle import compare, duck
from proxlab.plans.registry import load_all

QUERIES, ORACLES = load_all()
# the 80-iteration column-layout programs are covered by test_solvers (rows == cols)
SLOW = {"admm_cols", "admm_momentum_cols"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF_SMALL), ORACLES[name], con)
    assert r["match"], r


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

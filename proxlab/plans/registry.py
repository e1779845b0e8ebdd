"""Query registry: every operator as a Spark query over the driver tables, plus its SQL oracle.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  Computed floating-point columns are rounded
to 6 digits with -0.0 normalized (``rnd``) on both sides, so summation order does not leak
into the value hash.  Raw input values are never rounded.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rnd(c, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    r = F.round(c.cast("double"), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def load_all():
    """Import the query modules (each registers itself)."""
    from . import q_solvers  # noqa: F401
    from . import q_prep  # noqa: F401
    from . import q_linalg  # noqa: F401
    from . import q_metrics  # noqa: F401
    from . import q_learners  # noqa: F401
    return QUERIES, ORACLES

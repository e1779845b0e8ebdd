"""Linear-algebra kernels (L1-L6) in both layouts and the proximal maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prox import prox_col
from ..functions.vec import dot_lit
from ..operators import linalg
from . import fixtures as fx
from . import sqlgen as sg
from .registry import register, rnd

IDS = fx.LINEITEM_IDS
IDS_SQL = ", ".join(IDS)
D_PLANT = fx.sql_lineitem_design("planted")
X = fx.PLANT_W
_AX = " + ".join(f"f{j} * {sg.d(w)}" for j, w in enumerate(X))

MATVEC_SQL = f"SELECT {IDS_SQL}, {sg.rnd(_AX)} AS ax FROM ({D_PLANT}) A"
GRAD_SQL = " UNION ALL ".join(
    f"SELECT CAST({j} AS INTEGER) AS feat_id, {sg.rnd(f'sum(f{j} * (({_AX}) - label))')} AS value FROM ({D_PLANT}) A"
    for j in range(4))


@register("matvec_rows", MATVEC_SQL)
def q_matvec_rows(spark, sf_dir):
    """L1: A.x in the row layout, one codegen'd dot per row."""
    df = linalg.matvec_rows(fx.lineitem_design(spark, sf_dir), X)
    return df.select(*IDS, rnd("ax").alias("ax"))


@register("matvec_cols", MATVEC_SQL)
def q_matvec_cols(spark, sf_dir):
    """L2: A.x in the column layout: COO joined with x (broadcast, n rows), grouped by row id."""
    coo = linalg.to_coo(fx.lineitem_design(spark, sf_dir), IDS)
    ax = linalg.matvec_cols(coo, linalg.vector_df(spark, X), IDS, len(X), rows=fx.lineitem_design(spark, sf_dir))
    return ax.select(*IDS, rnd("ax").alias("ax"))


def _with_zeros(spark, sf_dir):
    """The planted design with rows (l_linenumber = 2) and a feature (the second) of zeros only."""
    zero = F.col("l_linenumber") == 2
    f = F.col("features")
    return fx.lineitem_design(spark, sf_dir).withColumn("features", F.array(
        *[F.when(zero, F.lit(0.0)).otherwise(F.lit(0.0) if j == 1 else f[j]) for j in range(4)]))


_ZERO = f"(SELECT {IDS_SQL}, label, " + ", ".join("CAST(0 AS DOUBLE) AS f1" if j == 1 else f"CASE WHEN l_linenumber = 2 THEN 0 ELSE f{j} END AS f{j}" for j in range(4)) + f" FROM ({D_PLANT}) A0)"


@register("matvec_cols_zeros", f"SELECT {IDS_SQL}, {sg.rnd(_AX)} AS ax FROM {_ZERO} A")
def q_matvec_cols_zeros(spark, sf_dir):
    """L2 with all-zero rows and an all-zero feature: every row appears."""
    df = _with_zeros(spark, sf_dir)
    ax = linalg.matvec_cols(linalg.to_coo(df, IDS), linalg.vector_df(spark, X), IDS, len(X), rows=df)
    return ax.select(*IDS, rnd("ax").alias("ax"))


@register("grad_cols_zeros", " UNION ALL ".join(
    f"SELECT CAST({j} AS INTEGER) AS feat_id, {sg.rnd(f'sum(f{j} * (({_AX}) - label))')} AS value FROM {_ZERO} A" for j in range(4)))
def q_grad_cols_zeros(spark, sf_dir):
    """L4 with all-zero rows and an all-zero feature: every feature appears."""
    return _grad_cols(spark, _with_zeros(spark, sf_dir))


@register("grad_rows", GRAD_SQL)
def q_grad_rows(spark, sf_dir):
    """L3 (+L1 fused): A^T (A x - b) in the row layout; partial sums map-side."""
    df = fx.lineitem_design(spark, sf_dir).withColumn("r", dot_lit("features", X) - F.col("label"))
    g = linalg.rmatvec_rows(df, "r", len(X))
    return g.select(F.col("feat_id").cast("int").alias("feat_id"), rnd("value").alias("value"))


@register("grad_cols", GRAD_SQL)
def q_grad_cols(spark, sf_dir):
    """L4 (+L2): A^T (A x - b) in the column layout: two grouped joins, no m-vector on the driver."""
    return _grad_cols(spark, fx.lineitem_design(spark, sf_dir))


def _grad_cols(spark, design):
    coo = linalg.to_coo(design, IDS)
    ax = linalg.matvec_cols(coo, linalg.vector_df(spark, X), IDS, len(X), rows=design)
    r = ax.join(design.select(*IDS, "label"), IDS).select(*IDS, (F.col("ax") - F.col("label")).alias("r"))
    g = linalg.rmatvec_cols(coo, r, IDS, out="value", n=len(X))
    return g.select("feat_id", rnd("value").alias("value"))


# ---------------------------------------------------------------- X1-X4 on events.value
PROX_SHIFT, PROX_T = 100.0, 25.0


def _prox_query(penalty):
    def q(spark, sf_dir):
        ev = fx.table(spark, sf_dir, "events")
        x = F.col("value") - PROX_SHIFT
        return ev.select("event_id", rnd(prox_col(penalty, x, PROX_T)).alias("prox"))
    return q


for _nm, _pen in (("prox_soft", "l1"), ("prox_half", "l_half"), ("prox_l2", "l2")):
    _x = f"(value - {sg.d(PROX_SHIFT)})"
    register(_nm, f"SELECT event_id, {sg.rnd(sg.prox_sql(_pen, _x, sg.d(PROX_T)))} AS prox FROM events")(
        _prox_query(_pen))

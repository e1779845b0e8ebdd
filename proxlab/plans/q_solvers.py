"""Solver queries (V1-V8) and solution-quality metrics (E11-E15) on the planted lineitem problem.

Problem: b = 0.8 qty/50 - 0.5 disc*10 + 0.3 + noise(key); features [qty/50, disc*10, tax*10, 1].
lambda = LAM_PER_ROW * m and the fixed step 1 / trace(A^T A) (a valid step: trace >= largest
eigenvalue) are derived from the data in the same pass, in Spark and in SQL alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import dot_lit
from ..operators import blocks, linalg, solvers
from ..sources import text
from . import fixtures as fx
from . import sqlgen as sg
from .registry import register, rnd

N = 4
LAM_PER_ROW = 0.01
MAXIT = 100
MAXIT_COLS = 80          # the column-layout programs run a fixed 80 iterations
APG_ALPHA = 0.9
ADMM_BETA = 0.1
SPLIT_MUL, SPLIT_SEED, SPLIT_PCT = 7919, 11, 60

DESIGN_SQL = fx.sql_lineitem_design("planted")
LAM_SQL = f"{sg.d(LAM_PER_ROW)} * CAST(m AS DOUBLE)"
STEP_SQL = f"{sg.d(1.0)} / tr"


def _weights(spark: SparkSession, res: solvers.SolverResult) -> DataFrame:
    w = res.weights_df(spark)
    return w.select("feat_id", rnd("weight").alias("weight"), rnd("extrapolated").alias("extrapolated"))


def _op(spark, sf_dir, layout="rows", method="gram", target="planted", where=None):
    df = fx.lineitem_design(spark, sf_dir, target)
    if where is not None:
        df = df.filter(where)
    return linalg.make_operator(df, N, layout=layout, method=method, id_cols=fx.LINEITEM_IDS)


def _run_fista(spark, sf_dir, penalty, line_search=False, method="gram", where=None):
    op = _op(spark, sf_dir, method=method, where=where)
    try:
        return solvers.fista(op, lam=LAM_PER_ROW * op.m, penalty=penalty, maxit=MAXIT,
                             step=1.0 / op.trace, line_search=line_search)
    finally:
        op.close()


def _fista_query(penalty):
    def q(spark, sf_dir):
        return _weights(spark, _run_fista(spark, sf_dir, penalty))
    return q


for _name, _pen in (("fista_lasso", "l1"), ("fista_ridge", "l2"), ("fista_lhalf", "l_half")):
    register(_name, sg.fista_sql(DESIGN_SQL, N, _pen, LAM_SQL, STEP_SQL, MAXIT))(_fista_query(_pen))


LIST_DESIGN = sg.list_design(DESIGN_SQL, N)


@register("fista_backtracking", sg.fista_search_sql(LIST_DESIGN, N, "l1", LAM_SQL, MAXIT))
def q_fista_backtracking(spark, sf_dir):
    """V1 as in the reference: start at step 1, backtrack by 2 (<= 20 trials), double every 10th."""
    op = _op(spark, sf_dir)
    try:
        res = solvers.fista(op, lam=LAM_PER_ROW * op.m, penalty="l1", maxit=MAXIT, step=1.0,
                            line_search=True, shrink=2.0, max_trials=20)
    finally:
        op.close()
    return _weights(spark, res)


@register("apg_restart", sg.apg_sql(DESIGN_SQL, N, "l1", LAM_SQL, STEP_SQL, APG_ALPHA, MAXIT))
def q_apg(spark, sf_dir):
    op = _op(spark, sf_dir)
    try:
        res = solvers.apg_restart(op, lam=LAM_PER_ROW * op.m, penalty="l1", alpha=APG_ALPHA,
                                  maxit=MAXIT, step=1.0 / op.trace)
    finally:
        op.close()
    return _weights(spark, res)


def _admm_query(momentum, line_search, maxit):
    def q(spark, sf_dir):
        op = _op(spark, sf_dir)
        try:
            res = solvers.admm(op, lam=LAM_PER_ROW * op.m, penalty="l1", beta=ADMM_BETA, u=1.0 / op.trace,
                               maxit=maxit, momentum=momentum, line_search=line_search, track=False)
        finally:
            op.close()
        return _weights(spark, res)
    return q


def _admm_columns_query(momentum, line_search, maxit):
    """V4/V6/V8 from the files of the column layout: A^T one column per line, b one number per line."""
    def q(spark, sf_dir):
        columns, b = fx.column_files(spark, sf_dir)
        matrix = blocks.from_column_lines(text.read_column_pieces(spark, columns))
        rhs = blocks.row_vector(text.read_vector_lines(spark, b), matrix.m)
        res = blocks.admm(matrix, rhs, lam=LAM_PER_ROW * matrix.m, penalty="l1", beta=ADMM_BETA, u=1.0 / matrix.trace,
                          maxit=maxit, momentum=momentum, line_search=line_search)
        matrix.close()
        return res.weights().select("feat_id", rnd("weight").alias("weight"), rnd("extrapolated").alias("extrapolated"))
    return q


for _layout, _it in (("rows", MAXIT), ("cols", MAXIT_COLS)):
    _make = _admm_columns_query if _layout == "cols" else _admm_query
    for _mom in (False, True):
        _nm = f"admm_{'momentum_' if _mom else ''}{_layout}"
        register(_nm, sg.admm_sql(DESIGN_SQL, N, "l1", LAM_SQL, ADMM_BETA, STEP_SQL, _it, _mom))(
            _make(_mom, False, _it))
    # V7/V8: momentum + step drawback, one trial per step of the recursion
    register(f"admm_drawback_{_layout}", sg.admm_search_sql(LIST_DESIGN, N, "l1", LAM_SQL, ADMM_BETA, STEP_SQL, _it))(
        _make(True, True, _it))


@register("loss_history", sg.fista_sql(DESIGN_SQL, N, "l1", LAM_SQL, STEP_SQL, MAXIT, history=True))
def q_loss_history(spark, sf_dir):
    """Objective and relative residual at each gradient point of fixed-step FISTA."""
    res = _run_fista(spark, sf_dir, "l1")
    h = res.history_df(spark)
    return h.select("iter", rnd("objective").alias("objective"), rnd("rel_residual").alias("rel_residual"))


# ---------------------------------------------------------------- E11-E14

_TRUTH_SQL = " + ".join(f"f{j} * {sg.d(w)}" for j, w in enumerate(fx.PLANT_W))


@register("residual_error",
          f"SELECT {sg.rnd('sqrt(sum((' + _TRUTH_SQL + ' - label) * (' + _TRUTH_SQL + ' - label)) / sum(label * label))')}"
          f" AS rel_residual FROM ({DESIGN_SQL}) A")
def q_residual_error(spark, sf_dir):
    """||A xT - b|| / ||b|| for the planted weights."""
    df = fx.lineitem_design(spark, sf_dir)
    r = dot_lit("features", fx.PLANT_W) - F.col("label")
    return df.agg(rnd(F.sqrt(F.sum(r * r) / F.sum(F.col("label") * F.col("label")))).alias("rel_residual"))


_SOLERR_TAIL = (
    "SELECT " + sg.rnd("se") + " AS sq_error, " + sg.rnd("se / tn") + " AS rel_sq_error, "
    + sg.rnd("sqrt(se / tn)") + " AS rel_error FROM (SELECT "
    + " + ".join(f"(x{j} - {sg.d(w)}) * (x{j} - {sg.d(w)})" for j, w in enumerate(fx.PLANT_W))
    + " AS se, " + " + ".join(f"{sg.d(w)} * {sg.d(w)}" for w in fx.PLANT_W) + " AS tn FROM {FINAL} f) s")


@register("solution_error", sg.fista_sql(DESIGN_SQL, N, "l1", LAM_SQL, STEP_SQL, MAXIT, tail=_SOLERR_TAIL))
def q_solution_error(spark, sf_dir):
    """||x - xT||^2, its ratio to ||xT||^2 and the root of the ratio."""
    res = _run_fista(spark, sf_dir, "l1")
    truth = np.array(fx.PLANT_W)
    xdf = linalg.vector_df(spark, res.x, "x").join(linalg.vector_df(spark, truth, "t"), "feat_id")
    agg = xdf.agg(F.sum((F.col("x") - F.col("t")) * (F.col("x") - F.col("t"))).alias("se"),
                  F.sum(F.col("t") * F.col("t")).alias("tn"))
    return agg.select(rnd("se").alias("sq_error"), rnd(F.col("se") / F.col("tn")).alias("rel_sq_error"),
                      rnd(F.sqrt(F.col("se") / F.col("tn"))).alias("rel_error"))


def _split_col(train: bool):
    c = F.pmod(F.col("l_orderkey") * SPLIT_MUL + SPLIT_SEED, F.lit(100)) < SPLIT_PCT
    return c if train else ~c


def _split_sql(train: bool) -> str:
    c = f"((l_orderkey * {SPLIT_MUL} + {SPLIT_SEED}) % 100 < {SPLIT_PCT})"
    return c if train else f"(NOT {c})"


_HOLDOUT_TAIL = (
    "SELECT " + sg.rnd("sum(abs(e))") + " AS l1_error, " + sg.rnd("sum(abs(e)) / sum(label * label)")
    + " AS l1_over_sq_norm, " + sg.rnd("sum(abs(e)) / sum(abs(label))") + " AS l1_over_l1_norm, "
    + "count(*) AS n_test FROM (SELECT T.label, ("
    + " + ".join(f"T.f{j} * W.x{j}" for j in range(N)) + ") - T.label AS e FROM ("
    + DESIGN_SQL + " WHERE " + _split_sql(False) + ") T, {FINAL} W) s")


@register("holdout_l1", sg.fista_sql(f"{DESIGN_SQL} WHERE {_split_sql(True)}", N, "l1", LAM_SQL, STEP_SQL,
                                     MAXIT, tail=_HOLDOUT_TAIL))
def q_holdout_l1(spark, sf_dir):
    """Train FISTA on the 60 % key-hash split, report sum |A x - b| on the 40 % rest."""
    res = _run_fista(spark, sf_dir, "l1", where=_split_col(True))
    test = fx.lineitem_design(spark, sf_dir).filter(_split_col(False))
    e = dot_lit("features", res.x) - F.col("label")
    agg = test.agg(F.sum(F.abs(e)).alias("l1"), F.sum(F.col("label") * F.col("label")).alias("bb"),
                   F.sum(F.abs("label")).alias("b1"), F.count(F.lit(1)).alias("n_test"))
    return agg.select(rnd("l1").alias("l1_error"), rnd(F.col("l1") / F.col("bb")).alias("l1_over_sq_norm"),
                      rnd(F.col("l1") / F.col("b1")).alias("l1_over_l1_norm"), "n_test")


register("fista_lasso_pass", sg.fista_sql(DESIGN_SQL, N, "l1", LAM_SQL, STEP_SQL, MAXIT))(
    lambda spark, sf_dir: _weights(spark, _run_fista(spark, sf_dir, "l1", method="pass")))


EMB_LAM, EMB_MAXIT = 1e-3, 300


@register("fista_lasso_embeddings", sg.fista_search_sql(fx.sql_embeddings_planted(), 64, "l1", f"{sg.d(EMB_LAM)} * CAST(m AS DOUBLE)", EMB_MAXIT))
def q_fista_lasso_embeddings(spark, sf_dir):
    """V1 on the 64-feature embeddings with a 6-sparse planted signal (Arrow Gram kernel, n > 24)."""
    df = fx.embeddings_planted(spark, sf_dir)
    op = linalg.make_operator(df, 64)
    try:
        res = solvers.fista(op, lam=EMB_LAM * op.m, penalty="l1", maxit=EMB_MAXIT, step=1.0, line_search=True)
    finally:
        op.close()
    return _weights(spark, res)

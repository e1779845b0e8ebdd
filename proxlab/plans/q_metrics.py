"""Evaluation queries (E1-E10) with SQL oracles.

Binary scores are a fixed linear score over the planted binary lineitem problem (areas
depend only on the score order, and a linear score is bit-identical in both engines).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vec import dot_lit
from ..operators import metrics as M
from . import fixtures as fx
from . import sqlgen as sg
from .registry import register, rnd

# fixed values: weights of the evaluation score over [qty/50, disc*10, tax*10, 1]
SCORE_W = [3.0, -2.0, 1.0, -1.0]
D_BIN = fx.sql_lineitem_design("binary")
_S = " + ".join(f"f{j} * {sg.d(w)}" for j, w in enumerate(SCORE_W))


def _scored(spark, sf_dir, hard=False):
    df = fx.lineitem_design(spark, sf_dir, "binary")
    s = dot_lit("features", SCORE_W)
    if hard:
        s = F.when(s > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.select(s.alias("score"), "label")


def _curve_sql(score_sql: str) -> str:
    return (f"WITH S AS (SELECT {score_sql} AS threshold, label AS y FROM ({D_BIN}) A), "
            "G AS (SELECT threshold, sum(CASE WHEN y > 0.5 THEN 1 ELSE 0 END) AS pos, "
            "sum(CASE WHEN y > 0.5 THEN 0 ELSE 1 END) AS neg FROM S GROUP BY threshold), "
            "C AS (SELECT threshold, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg, "
            "CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp, "
            "CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp, "
            "CAST(sum(pos) OVER () AS DOUBLE) AS P, CAST(sum(neg) OVER () AS DOUBLE) AS N FROM G), "
            "K AS (SELECT *, tp / (tp + fp) AS prec, CASE WHEN (tp - pos) + (fp - neg) > 0 "
            "THEN (tp - pos) / ((tp - pos) + (fp - neg)) ELSE tp / (tp + fp) END AS prev_prec FROM C)")


def _areas_sql(score_sql: str) -> str:
    return (_curve_sql(score_sql)
            + f" SELECT {sg.rnd('sum(neg * (2 * tp - pos)) / (2.0 * P * N)')} AS auc_roc, "
              f"{sg.rnd('sum((pos / P) * (prec + prev_prec) / 2.0)')} AS auc_pr, "
              "CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg FROM K GROUP BY P, N")


def _areas(df):
    a = M.binary_areas(M.binary_points(df, "score", "label"))
    return a.select(rnd("auc_roc").alias("auc_roc"), rnd("auc_pr").alias("auc_pr"), "n_pos", "n_neg")


@register("auc_scores", _areas_sql(_S))
def q_auc_scores(spark, sf_dir):
    """Areas under ROC and PR from real-valued scores (distributed two-level scan)."""
    return _areas(_scored(spark, sf_dir))


_NULL_SCORE = f"CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN CAST('NaN' AS DOUBLE) ELSE {_S} END"
_NULL_LABEL = "CASE WHEN l_linenumber = 5 THEN NULL ELSE label END"


@register("auc_with_nulls", f"WITH S AS (SELECT {_NULL_SCORE} AS s, {_NULL_LABEL} AS y FROM ({D_BIN}) A) SELECT count(*) AS n_rows, "
          "count(*) FILTER (WHERE s IS NULL OR isnan(s)) AS n_bad_score, count(*) FILTER (WHERE y IS NULL) AS n_bad_label, "
          "count(*) FILTER (WHERE s IS NOT NULL AND NOT isnan(s) AND y = 1) AS n_pos, "
          "count(*) FILTER (WHERE s IS NOT NULL AND NOT isnan(s) AND y = 0) AS n_neg FROM S")
def q_auc_with_nulls(spark, sf_dir):
    """Null and NaN scores and null labels are counted, not taken for negatives."""
    df = fx.lineitem_design(spark, sf_dir, "binary")
    n = F.col("l_linenumber")
    df = df.select(F.when(n == 3, F.lit(None)).when(n == 4, F.lit(float("nan"))).otherwise(dot_lit("features", SCORE_W)).alias("score"),
                   F.when(n == 5, F.lit(None)).otherwise(F.col("label")).alias("label"))
    areas = M.binary_areas(M.binary_points(df, "score", "label", invalid="skip")).select("n_pos", "n_neg")
    return M.unusable_counts(df, "score", "label").drop("n_used").join(F.broadcast(areas))


@register("auc_hard", _areas_sql(f"CASE WHEN ({_S}) > 0 THEN {sg.d(1.0)} ELSE {sg.d(0.0)} END"))
def q_auc_hard(spark, sf_dir):
    """The same areas computed from hard 0/1 predictions (two thresholds)."""
    return _areas(_scored(spark, sf_dir, hard=True))


@register("metrics_by_threshold",
          _curve_sql(_S) + f" SELECT threshold, {sg.rnd('prec')} AS precision, {sg.rnd('tp / P')} AS recall, "
          f"{sg.rnd('CASE WHEN prec + tp / P > 0 THEN 2.0 * prec * (tp / P) / (prec + tp / P) ELSE 0.0 END')} "
          "AS f_measure FROM K")
def q_metrics_by_threshold(spark, sf_dir):
    """Precision / recall / F1 at every distinct score."""
    t = M.threshold_metrics(M.binary_points(_scored(spark, sf_dir), "score", "label"))
    return t.select("threshold", rnd("precision").alias("precision"), rnd("recall").alias("recall"),
                    rnd("f_measure").alias("f_measure"))


_S0 = " + ".join(f"f{j} * {sg.d(w)}" for j, w in enumerate(fx.CLS_W))
_PRED_SQL = (f"CAST(CASE WHEN ({_S0}) < {fx.MULTI_CUTS[0]!r} THEN 0.0 "
             f"WHEN ({_S0}) < {fx.MULTI_CUTS[1]!r} THEN 1.0 ELSE 2.0 END AS DOUBLE)")


@register("multiclass_metrics",
          f"WITH T AS (SELECT label AS y, {_PRED_SQL} AS p FROM ({fx.sql_lineitem_design('multi')}) A), "
          "conf AS (SELECT y, p, count(*) AS n FROM T GROUP BY y, p), "
          "bl AS (SELECT y, CAST(sum(n) AS DOUBLE) AS n_y, CAST(sum(CASE WHEN y = p THEN n ELSE 0 END) AS DOUBLE) "
          "AS tp FROM conf GROUP BY y), bp AS (SELECT p, CAST(sum(n) AS DOUBLE) AS n_p FROM conf GROUP BY p), "
          "k AS (SELECT bl.*, bp.n_p, CASE WHEN coalesce(bp.n_p, 0) > 0 THEN bl.tp / bp.n_p ELSE 0.0 END AS prec, "
          "bl.tp / bl.n_y AS rec FROM bl LEFT JOIN bp ON bl.y = bp.p), "
          "k2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM k) "
          f"SELECT {sg.rnd('sum(tp) / sum(n_y)')} AS accuracy, {sg.rnd('sum(prec * n_y) / sum(n_y)')} "
          f"AS weighted_precision, {sg.rnd('sum(rec * n_y) / sum(n_y)')} AS weighted_recall, "
          f"{sg.rnd('sum(f1 * n_y) / sum(n_y)')} AS weighted_f1 FROM k2")
def q_multiclass_metrics(spark, sf_dir):
    """Accuracy, weighted precision / recall / F1 of a 3-class rule vs the noisy labels."""
    lab = fx.lineitem_design(spark, sf_dir, "multi")
    m = M.multiclass_metrics(lab.select("label", _pred_from_features().alias("prediction")))
    return m.select(*[rnd(c).alias(c) for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")])


def _pred_from_features():
    s0 = dot_lit("features", fx.CLS_W)
    return F.when(s0 < fx.MULTI_CUTS[0], 0.0).when(s0 < fx.MULTI_CUTS[1], 1.0).otherwise(2.0)


_TRUTH = " + ".join(f"f{j} * {sg.d(w)}" for j, w in enumerate(fx.PLANT_W))


@register("regression_metrics",
          f"SELECT {sg.rnd('sqrt(sse / n)')} AS rmse, {sg.rnd('sse / n')} AS mse, {sg.rnd('sae / n')} AS mae, "
          f"{sg.rnd('1.0 - sse / (var_y * n)')} AS r2 FROM (SELECT sum(e * e) AS sse, sum(abs(e)) AS sae, "
          f"CAST(count(*) AS DOUBLE) AS n, var_pop(label) AS var_y FROM (SELECT label, ({_TRUTH}) - label AS e "
          f"FROM ({fx.sql_lineitem_design('planted')}) A) a) b")
def q_regression_metrics(spark, sf_dir):
    """Rmse, mse, mae, r2 of the planted linear predictor."""
    df = fx.lineitem_design(spark, sf_dir).select(dot_lit("features", fx.PLANT_W).alias("prediction"), "label")
    m = M.regression_metrics(df)
    return m.select(*[rnd(c).alias(c) for c in ("rmse", "mse", "mae", "r2")])


@register("pr_scores",
          _curve_sql(_S) + f" SELECT {sg.d(0.0)} AS recall, {sg.rnd('prec')} AS precision FROM K "
          "WHERE tp - pos = 0 AND fp - neg = 0 "
          f"UNION ALL SELECT {sg.rnd('tp / P')} AS recall, {sg.rnd('prec')} AS precision FROM K")
def q_pr_scores(spark, sf_dir):
    """The precision-recall curve from real-valued scores (leading point at recall 0)."""
    c = M.pr_curve(M.binary_points(_scored(spark, sf_dir), "score", "label"))
    return c.select(rnd("recall").alias("recall"), rnd("precision").alias("precision"))

"""Learner queries: logistic models (C1-C11, E15, E16); trees, boosting and tuning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import linalg, logistic, solvers
from . import fixtures as fx
from . import sqlgen as sg
from .registry import register, rnd

IDS = fx.LINEITEM_IDS
IDS_SQL = ", ".join(IDS)
D_PLANT = fx.sql_lineitem_design("planted")


def _weights(res, spark):
    return res.weights_df(spark).select("class", "feat_id", rnd("weight").alias("weight"))


def _emb_with_bias(spark, sf_dir):
    e = fx.embeddings_design(spark, sf_dir)
    return e.withColumn("features", F.concat("features", F.array(F.lit(1.0))))


@register("logit_lbfgs_binary")
def q_logit_lbfgs_binary(spark, sf_dir):
    """Binary logistic by L-BFGS; L2 (0.1) on all weights incl. the bias column; 10 corrections."""
    df = fx.lineitem_design(spark, sf_dir, "binary")
    return _weights(logistic.fit_lbfgs(df, 4, 2, reg=0.1, corrections=10, tol=1e-5, maxit=100), spark)


@register("logit_lbfgs_history")
def q_logit_lbfgs_history(spark, sf_dir):
    """E15 for C1: objective per L-BFGS iteration."""
    df = fx.lineitem_design(spark, sf_dir, "binary")
    res = logistic.fit_lbfgs(df, 4, 2, reg=0.1, corrections=10, tol=1e-5, maxit=100)
    return res.history_df(spark).select("iter", rnd("objective").alias("objective"))


@register("logit_sgd_multinomial")
def q_logit_sgd_multinomial(spark, sf_dir):
    """10-class softmax (pivot 0) by mini-batch SGD: step 10/sqrt(i), 200 iterations, 1 % batches."""
    df = _emb_with_bias(spark, sf_dir)
    res = logistic.fit_minibatch_sgd(df, 65, 10, step_size=10.0, iters=200, reg=1e-3, fraction=0.01)
    return _weights(res, spark)


@register("logit_sgd_binary")
def q_logit_sgd_binary(spark, sf_dir):
    """The same SGD with K = 2 on the planted binary lineitem problem."""
    df = fx.lineitem_design(spark, sf_dir, "binary")
    return _weights(logistic.fit_minibatch_sgd(df, 4, 2, step_size=10.0, iters=200, reg=1e-3, fraction=0.01), spark)


@register("logit_parallel_sgd")
def q_logit_parallel_sgd(spark, sf_dir):
    """Parallel local SGD with per-epoch weighted averaging (100 epochs)."""
    df = fx.lineitem_design(spark, sf_dir, "binary").withColumn("_k", F.xxhash64(*IDS))
    res = logistic.fit_parallel_sgd(df, 4, 2, epochs=100, step_size=1.0, key="_k")
    return _weights(res, spark)


@register("logit_parallel_sgd_multi")
def q_logit_parallel_sgd_multi(spark, sf_dir):
    """C4: the multinomial variant on the embeddings (10 classes)."""
    df = _emb_with_bias(spark, sf_dir)
    res = logistic.fit_parallel_sgd(df, 65, 10, epochs=100, step_size=1.0, key="vec_id")
    return _weights(res, spark)


@register("logit_lbfgs_multinomial")
def q_logit_lbfgs_multinomial(spark, sf_dir):
    """Pyspark.ml multinomial L-BFGS, no intercept, no regularization."""
    from pyspark.ml.functions import array_to_vector
    df = fx.embeddings_design(spark, sf_dir).withColumn("features", array_to_vector("features"))
    model = logistic.multinomial_lbfgs().fit(df)
    rep = logistic.coefficient_report(spark, model)
    return rep.select("class", "feat_id", rnd("weight").alias("weight"))


def _en_query(family):
    def q(spark, sf_dir):
        from pyspark.ml.functions import array_to_vector
        from ..operators.prep import hash_split_col
        df = fx.lineitem_design(spark, sf_dir, "binary")
        df = df.select(F.slice("features", 1, 3).alias("features"), "label", "l_orderkey")
        train = df.filter(hash_split_col("l_orderkey", 80, 0)).withColumn("features", array_to_vector("features"))
        model = logistic.elastic_net(family=family).fit(train)
        rep = logistic.coefficient_report(spark, model)
        return rep.select("class", "feat_id", rnd("weight").alias("weight"))
    return q


register("logit_elastic_net")(_en_query("binomial"))
register("logit_elastic_net_multinomial")(_en_query("multinomial"))

_HOLDOUT_MODELS = ("lbfgs", "minibatch_sgd", "parallel_sgd", "elastic_net")


@register("logit_holdout", "SELECT model, count(*) FILTER (WHERE tr) AS n_train, count(*) FILTER (WHERE NOT tr) AS n_test, "
          "count(*) FILTER (WHERE NOT tr AND label = 1) AS n_pos_test, true AS auc_beats_chance, true AS accuracy_beats_constant "
          f"FROM (SELECT label, (l_orderkey * 7919 + 11) % 100 < 60 AS tr FROM ({fx.sql_lineitem_design('binary')}) A) s, "
          f"(VALUES {', '.join(f'({m!r})' for m in _HOLDOUT_MODELS)}) v(model) GROUP BY model")
def q_logit_holdout(spark, sf_dir):
    """C1, C3, C6, C7 with E1-E4: fitted on the 60 % split, scored on the rest, held against chance and the constant class."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import types as T
    from ..operators import metrics
    from ..operators.prep import hash_split_col
    df = fx.lineitem_design(spark, sf_dir, "binary")
    is_train = hash_split_col("l_orderkey", 60, 11)
    train, test = df.filter(is_train).persist(), df.filter(~is_train).persist()
    try:
        key = train.withColumn("_k", F.xxhash64(*IDS))
        plain = train.select(F.slice("features", 1, 3).alias("features"), "label").withColumn("features", array_to_vector("features"))
        net = logistic.elastic_net(reg=0.01).fit(plain)
        weights = {"lbfgs": logistic.fit_lbfgs(train, 4, 2, reg=0.1, tol=1e-5).weights,
                   "minibatch_sgd": logistic.fit_minibatch_sgd(key, 4, 2, iters=50, key="_k").weights,
                   "parallel_sgd": logistic.fit_parallel_sgd(key, 4, 2, epochs=20, key="_k").weights,
                   "elastic_net": [*net.coefficients.toArray(), net.intercept]}
        n_train = train.count()
        rows = []
        for model in _HOLDOUT_MODELS:
            pred = test.select(logistic.predict_score("features", weights[model]).alias("score"), "label")
            area = metrics.binary_areas(metrics.binary_points(pred, "score", "label")).first()
            hard = metrics.multiclass_metrics(pred.withColumn("prediction", F.when(F.col("score") < 0.5, 0.0).otherwise(1.0))).first()
            n_test = area["n_pos"] + area["n_neg"]
            rows.append((model, n_train, n_test, area["n_pos"], area["auc_roc"] > 0.5,
                         hard["accuracy"] > max(area["n_pos"], area["n_neg"]) / n_test))
    finally:
        train.unpersist()
        test.unpersist()
    schema = T.StructType([T.StructField("model", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_train", "n_test", "n_pos_test")],
                           T.StructField("auc_beats_chance", T.BooleanType()), T.StructField("accuracy_beats_constant", T.BooleanType())])
    return spark.createDataFrame(rows, schema)


# fixed values: the scoring weights used by the prediction operators
PRED_W = [4.0, -3.0, 2.0, -1.5]
PRED_W3 = [[4.0, -3.0, 2.0, -1.5], [8.0, -6.0, 4.0, -3.0]]


def _dot_sql(w):
    return " + ".join(f"f{j} * {sg.d(v)}" for j, v in enumerate(w))


@register("predict_score", f"SELECT {IDS_SQL}, "
          + sg.rnd(f"{sg.d(1.0)} / ({sg.d(1.0)} + exp(-(({_dot_sql(PRED_W)}) + {sg.d(0.0)})))")
          + f" AS score FROM ({D_PLANT}) A")
def q_predict_score(spark, sf_dir):
    """Sigmoid scores (threshold cleared) from a weight vector."""
    df = fx.lineitem_design(spark, sf_dir)
    return df.select(*IDS, rnd(logistic.predict_score("features", PRED_W)).alias("score"))


@register("predict_class", f"SELECT {IDS_SQL}, CAST(list_position(list_value({sg.d(0.0)}, "
          f"{_dot_sql(PRED_W3[0])}, {_dot_sql(PRED_W3[1])}), list_max(list_value({sg.d(0.0)}, "
          f"{_dot_sql(PRED_W3[0])}, {_dot_sql(PRED_W3[1])}))) - 1 AS DOUBLE) AS prediction FROM ({D_PLANT}) A")
def q_predict_class(spark, sf_dir):
    """Multinomial argmax with pivot class 0."""
    df = fx.lineitem_design(spark, sf_dir)
    return df.select(*IDS, logistic.predict_class("features", PRED_W3).alias("prediction"))


_PL_TAIL = (f"SELECT {', '.join('T.' + c for c in IDS)}, "
            + sg.rnd(" + ".join(f"T.f{j} * W.x{j}" for j in range(4)))
            + f" AS prediction FROM ({D_PLANT}) T, {{FINAL}} W")


@register("predict_linear", sg.fista_sql(D_PLANT, 4, "l1", f"{sg.d(0.01)} * CAST(m AS DOUBLE)",
                                         f"{sg.d(1.0)} / tr", 100, tail=_PL_TAIL))
def q_predict_linear(spark, sf_dir):
    """C11: a.x with weights fitted by fixed-step FISTA."""
    df = fx.lineitem_design(spark, sf_dir)
    op = linalg.make_operator(df, 4)
    res = solvers.fista(op, lam=0.01 * op.m, penalty="l1", maxit=100, step=1.0 / op.trace, line_search=False)
    return df.select(*IDS, rnd(logistic.predict_linear("features", res.x)).alias("prediction"))


# ---------------------------------------------------------------- T1-T19, S8, S9
from ..operators import tabular  # noqa: E402

_DATASETS = {
    "bank": (fx.bank_table, "y", "l_orderkey", "binary", []),
    "covtype": (fx.covtype_table, "Cover_Type", "l_orderkey", "multi", []),
    "house": (fx.house_table, "SalePrice", "p_partkey", "regression", ["p_name"]),
}
_XGB_GRID = {"maxDepth": [4, 8], "minChildWeight": [0.1], "gamma": [0.1], "regAlpha": [0.0],
             "regLambda": [0.6], "eta": [0.4]}
_OBJ = {"binary": "binary:logistic", "multi": "multi:softprob", "regression": "reg:squarederror"}

# (query, learner family, dataset, grid, learner params, split seed)
_TABULAR = [
    ("dt_bank", "dt", "bank", {"maxDepth": [4, 8], "minInstancesPerNode": [1], "minInfoGain": [0.1],
                               "impurity": ["gini"]}, {}, 0),
    ("dt_covtype", "dt", "covtype", {"maxDepth": [4, 5, 6]}, {}, 1234),
    ("dt_house", "dt", "house", {"maxDepth": [4, 5], "impurity": ["variance"]}, {}, 0),
    ("rf_bank", "rf", "bank", {"numTrees": [20], "maxDepth": [4, 8], "impurity": ["gini"]}, {}, 0),
    ("rf_covtype", "rf", "covtype", {"maxDepth": [4, 8], "impurity": ["gini"]}, {}, 1234),
    ("rf_house", "rf", "house", {"maxDepth": [4, 8], "impurity": ["variance"]}, {}, 0),
    # GBT with impurity "gini" is rejected by Spark; gradient boosting always fits variance trees
    ("gbt_bank", "gbt", "bank", {"maxIter": [100], "maxDepth": [4, 8], "impurity": ["variance"]}, {}, 0),
    ("gbt_house", "gbt", "house", {"maxDepth": [4, 8], "impurity": ["variance"]}, {}, 0),
    # boosting rounds are a parameter of the learner; the registered queries use its default
    ("xgb_bank", "xgb", "bank", _XGB_GRID, {"numRound": 20}, 0),
    ("xgb_covtype", "xgb", "covtype", _XGB_GRID, {"numRound": 20}, 0),
    ("xgb_house", "xgb", "house", _XGB_GRID, {"numRound": 20}, 0),
    ("lgbm_bank", "lgbm", "bank", {"objective": [_OBJ["binary"]]}, {"numRound": 20}, 0),
    ("lgbm_covtype", "lgbm", "covtype", {"objective": [_OBJ["multi"]]}, {"numRound": 20}, 1234),
    ("lgbm_house", "lgbm", "house", {"objective": [_OBJ["regression"]]}, {"numRound": 20}, 0),
]


def _run_tabular(spark, sf_dir, kind, ds, grid, params, seed):
    make, label, key, task, drop = _DATASETS[ds]
    return tabular.train_tabular(make(spark, sf_dir), label, kind, task, grid, key, split_seed=seed,
                                 learner_params=params, drop=drop)


#: key and label of each dataset's complete rows
_ROWS_SQL = {
    "bank": f"SELECT l_orderkey AS k, CASE WHEN {fx.sql_class_score()} > 0 THEN 'yes' ELSE 'no' END AS y FROM lineitem",
    "covtype": f"SELECT l_orderkey AS k, CASE WHEN {fx.sql_class_score()} < {fx.MULTI_CUTS[0]!r} THEN 1 WHEN {fx.sql_class_score()} < {fx.MULTI_CUTS[1]!r} THEN 2 ELSE 3 END AS y FROM lineitem",
    "house": f"SELECT p_partkey AS k, p_size * {sg.d(fx.HOUSE_SIZE_W)} + length(p_type) * {sg.d(fx.HOUSE_TYPE_W)} + CAST(p_partkey * {fx.HASH_MUL[0]} % 1000 AS DOUBLE) / {sg.d(10.0)} AS y "
             "FROM part WHERE p_partkey % 13 <> 5 AND p_partkey % 17 <> 0",
}


def _baseline_sql(ds: str, seed: int) -> str:
    if _DATASETS[ds][3] == "regression":
        value = "(SELECT sqrt(avg((y - (SELECT avg(y) FROM S WHERE train)) * (y - (SELECT avg(y) FROM S WHERE train)))) FROM S WHERE NOT train)"
    else:
        value = "(SELECT avg(CASE WHEN y = (SELECT y FROM S WHERE train GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) THEN 1.0 ELSE 0.0 END) FROM S WHERE NOT train)"
    return (f"WITH S AS (SELECT y, (k * 7919 + {seed}) % 100 < 80 AS train FROM ({_ROWS_SQL[ds]}) r) "
            "SELECT 'n_train' AS metric, CAST(count(*) AS DOUBLE) AS value FROM S WHERE train UNION ALL SELECT 'n_test', CAST(count(*) AS DOUBLE) FROM S WHERE NOT train "
            f"UNION ALL SELECT 'baseline', {sg.rnd(f'CAST({value} AS DOUBLE)')} UNION ALL SELECT 'beats_baseline', {sg.d(1.0)}")


def _tabular_query(kind, ds, grid, params, seed):
    """Rows of the held-out check: sizes of the split, the constant prediction's score, and whether the tuned model beats it."""
    def q(spark, sf_dir):
        make, label, key, task, drop = _DATASETS[ds]
        res, pred = _run_tabular(spark, sf_dir, kind, ds, grid, params, seed)
        pred.unpersist()
        base = tabular.baseline(make(spark, sf_dir), label, key, task, seed, drop)
        rows = [*((k, float(v)) for k, v in base.items()), ("beats_baseline", float(tabular.beats(res.metrics, base, task)))]
        return spark.createDataFrame(rows, "metric string, value double").select("metric", rnd("value").alias("value"))
    return q


for _q, _kind, _ds, _grid, _params, _seed in _TABULAR:
    register(_q, _baseline_sql(_ds, _seed))(_tabular_query(_kind, _ds, _grid, _params, _seed))


@register("tabular_report")
def q_tabular_report(spark, sf_dir):
    """Every held-out metric of the tuned booster on the regression table."""
    res, pred = _run_tabular(spark, sf_dir, "xgb", "house", _XGB_GRID, {"numRound": 20}, 0)
    pred.unpersist()
    return tabular.metrics_df(spark, res).select("metric", rnd("value").alias("value"))


@register("cv_select")
def q_cv_select(spark, sf_dir):
    """The parameter grid with its 3-fold average metric (the best one is selected)."""
    res, pred = _run_tabular(spark, sf_dir, "dt", "covtype", {"maxDepth": [4, 5, 6]}, {}, 1234)
    pred.unpersist()
    return tabular.cv_df(spark, res).select("grid_index", "params", rnd("avg_metric").alias("avg_metric"))


@register("model_roundtrip", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM lineitem")
def q_model_roundtrip(spark, sf_dir):
    """Predictions of the saved-and-reloaded booster pipeline equal the in-memory model's,
    compared row by row on the unique lineitem key."""
    from pyspark.ml import Pipeline, PipelineModel
    from ..operators import prep
    from ..session import scratch_path
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    df = fx.bank_table(spark, sf_dir, with_row_key=True).na.drop()
    roles = prep.column_roles(df.schema, "y", exclude=["l_orderkey", "l_linenumber", "l_partkey"])
    stages = prep.feature_stages(df, roles, index_label=True)
    stages[0].setOutputCol("label")
    est = tabular.learner("xgb", "binary", maxDepth=4, numRound=5)
    model = Pipeline(stages=stages + [est]).fit(df)
    path = scratch_path(spark, "roundtrip")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = model.transform(df).select(*keys, F.col("prediction").alias("p1"))
    b = again.transform(df).select(*keys, F.col("prediction").alias("p2"))
    keyed = a.join(b, keys)
    return keyed.agg(F.count(F.lit(1)).alias("rows"),
                     F.sum(F.when(F.col("p1") != F.col("p2"), 1).otherwise(0)).alias("mismatches"))


# ---------------------------------------------------------------- booster kernel (T9-T14) with oracles
_BH_LAMBDA = 1.0
_BH_SQL_FEATS = " UNION ALL ".join(
    f"SELECT CAST({j} AS INTEGER) AS feat_id, f{j} AS x, label FROM ({D_PLANT}) A" for j in range(3))
_BH_BINS = (f"SELECT feat_id, x, label, CAST(dense_rank() OVER (PARTITION BY feat_id ORDER BY x) AS INTEGER) "
            f"AS bin FROM ({_BH_SQL_FEATS}) u")


def _root_fit(spark, sf_dir):
    """The squared-error booster (base 0) on [qty/50, disc*10, tax*10], its bins made."""
    from ..operators import bins, boost
    df = fx.lineitem_design(spark, sf_dir).select(F.slice("features", 1, 3).alias("features"), "label", F.lit(-1).alias("fold"))
    est = boost.HistBoost(objective="reg:squarederror", regLambda=_BH_LAMBDA, minChildWeight=1.0, gamma=0.0)
    found = bins.find_bins(df.select("features"), "features", 64, False)
    return boost.Fit(df, found, "reg:squarederror", 1, [boost.Spec(est.rule(), 1, None, np.zeros(1))], "spark")


def _root_sums(fit):
    from ..operators import boost
    grower = boost.Grower(fit.specs[0].rule, fit.bins)
    return fit.summed({(0, 0): grower}, [((0, 0), 0)]), grower


@register("boost_histogram",
          f"SELECT feat_id, bin, {sg.rnd('sum(-label)')} AS g, {sg.rnd('CAST(count(*) AS DOUBLE)')} AS h "
          f"FROM ({_BH_BINS}) b GROUP BY feat_id, bin")
def q_boost_histogram(spark, sf_dir):
    """Booster kernel: per-(feature, bin) gradient and hessian sums at the root (exact bins, zeros by difference)."""
    from ..operators import boost
    fit = _root_fit(spark, sf_dir)
    cells, _ = boost.node_bins(_root_sums(fit)[0], fit.bins)
    return cells.select(F.col("feat").cast("int").alias("feat_id"), F.col("bin").cast("int").alias("bin"), rnd("g").alias("g"), rnd("h").alias("h"))


_BS_SQL = (
    f"WITH B AS ({_BH_BINS}), "
    "C AS (SELECT feat_id, bin, max(x) AS x, sum(-label) AS g, CAST(count(*) AS DOUBLE) AS h FROM B GROUP BY feat_id, bin), "
    "T AS (SELECT feat_id, sum(g) OVER (PARTITION BY feat_id) AS gt, sum(h) OVER (PARTITION BY feat_id) AS ht, bin, x, "
    "max(bin) OVER (PARTITION BY feat_id) AS maxbin, "
    "sum(g) OVER (PARTITION BY feat_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS gl, "
    "sum(h) OVER (PARTITION BY feat_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS hl FROM C), "
    f"S AS (SELECT feat_id, bin, x, hl, ht - hl AS hr, {sg.d(0.5)} * (gl * gl / (hl + {sg.d(_BH_LAMBDA)}) + "
    f"(gt - gl) * (gt - gl) / ((ht - hl) + {sg.d(_BH_LAMBDA)}) - gt * gt / (ht + {sg.d(_BH_LAMBDA)})) AS gain "
    "FROM T WHERE bin < maxbin AND hl >= 1 AND ht - hl >= 1) "
    f"SELECT feat_id, bin, x AS threshold, {sg.rnd('gain')} AS gain, hl AS h_left, hr AS h_right "
    "FROM S ORDER BY gain DESC, feat_id, bin LIMIT 1")


@register("boost_best_split", _BS_SQL)
def q_boost_best_split(spark, sf_dir):
    """Booster kernel: the root split chosen in Spark (gain with lambda = 1, gamma = 0)."""
    from ..operators import boost
    fit = _root_fit(spark, sf_dir)
    sums, grower = _root_sums(fit)
    edge = spark.createDataFrame([(j, b + 1, float(x)) for j, e in enumerate(fit.bins.edges) for b, x in enumerate(e)], "feat long, bin long, threshold double")
    found = boost.searched(sums, fit.bins, [grower.rule]).select("split.*").join(F.broadcast(edge), ["feat", "bin"])
    return found.select(F.col("feat").cast("int").alias("feat_id"), F.col("bin").cast("int").alias("bin"), "threshold", rnd("gain").alias("gain"),
                        F.col("hl").alias("h_left"), F.col("hr").alias("h_right"))


_LEAVES = 8
_TREE_SQL = f"""
WITH RECURSIVE D AS (
  SELECT dense_rank() OVER (ORDER BY f0) AS b0, dense_rank() OVER (ORDER BY f1) AS b1, dense_rank() OVER (ORDER BY f2) AS b2, label FROM ({D_PLANT}) A),
cells AS MATERIALIZED (SELECT b0, b1, b2, sum(-label) AS g, CAST(count(*) AS DOUBLE) AS h FROM D GROUP BY b0, b1, b2),
it AS (
  SELECT 0 AS step, 0 AS leaf, b0, b1, b2, g, h FROM cells
  UNION ALL
  SELECT step + 1, CASE WHEN leaf = best.leaf AND (CASE best.feat WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END) > best.bin THEN step + 1 ELSE leaf END, b0, b1, b2, g, h
  FROM (
    SELECT *, first_value({{'leaf': leaf, 'feat': feat, 'bin': bin}}) OVER (ORDER BY gain DESC, feat, bin) AS best FROM (
      SELECT *, CASE WHEN hl >= 1 AND ht - hl >= 1 THEN {sg.d(0.5)} * (gl * gl / (hl + {sg.d(_BH_LAMBDA)}) + (gt - gl) * (gt - gl) / (ht - hl + {sg.d(_BH_LAMBDA)})
             - gt * gt / (ht + {sg.d(_BH_LAMBDA)})) ELSE -1 END AS gain FROM (
        SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY leaf, feat) AS gt, sum(h) OVER (PARTITION BY leaf, feat) AS ht FROM (
          SELECT *, CASE feat WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS bin FROM it, (VALUES (0), (1), (2)) f(feat) WHERE step < {_LEAVES - 1}) q0
        WINDOW w AS (PARTITION BY leaf, feat ORDER BY bin RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q1) q2) q3
  WHERE feat = 0)
SELECT {sg.rnd(f'-sum(g) / (sum(h) + {sg.d(_BH_LAMBDA)})')} AS value, CAST(sum(h) AS BIGINT) AS n_rows FROM it WHERE step = {_LEAVES - 1} GROUP BY leaf
"""


def _tree_query(search):
    def q(spark, sf_dir):
        """One best-first tree of eight leaves; each leaf's value and number of rows."""
        from ..operators import boost
        df = fx.lineitem_design(spark, sf_dir).select(F.slice("features", 1, 3).alias("features"), "label")
        model = boost.HistBoost(objective="reg:squarederror", numRound=1, eta=1.0, regLambda=_BH_LAMBDA, minChildWeight=1.0, growth="leaf",
                                numLeaves=_LEAVES, maxDepth=-1, splitSearch=search).fit(df)
        return model.transform(df).groupBy("prediction").agg(F.count("*").alias("n_rows")).select(rnd("prediction").alias("value"), "n_rows")
    return q


register("boost_tree", _TREE_SQL)(_tree_query("driver"))
register("boost_tree_in_spark", _TREE_SQL)(_tree_query("spark"))

_SPARSE_SQL = (
    f"WITH C AS (SELECT l_partkey, sum(-label) AS g, CAST(count(*) AS DOUBLE) AS h FROM ({D_PLANT}) A GROUP BY l_partkey), "
    "T AS (SELECT sum(g) AS gt, sum(h) AS ht FROM C), "
    f"S AS (SELECT l_partkey, h, ht, {sg.d(0.5)} * (g * g / (h + {sg.d(_BH_LAMBDA)}) + (gt - g) * (gt - g) / (ht - h + {sg.d(_BH_LAMBDA)}) "
    f"- gt * gt / (ht + {sg.d(_BH_LAMBDA)})) AS gain FROM C, T) "
    f"SELECT l_partkey AS category, h AS h_with, ht - h AS h_without, {sg.rnd('gain')} AS gain FROM S WHERE h >= 1 AND ht - h >= 1 ORDER BY gain DESC, l_partkey LIMIT 1")


@register("boost_sparse_categories", _SPARSE_SQL)
def q_boost_sparse_categories(spark, sf_dir):
    """The root split over a one-hot column of every part key, from sparse rows: one bundle, one code a row."""
    from pyspark.ml.feature import OneHotEncoder
    from ..operators import bins, boost
    df = fx.lineitem_design(spark, sf_dir).select(F.col("l_partkey").cast("double").alias("part"), "label")
    df = OneHotEncoder(inputCols=["part"], outputCols=["features"], dropLast=False).fit(df).transform(df)
    # the encoder names every category in the column's metadata, which Python would read with every schema
    df = df.select(F.col("features").alias("features", metadata={"named": False}), "label", F.lit(-1).alias("fold"))
    est = boost.xgboost_like("reg:squarederror", regLambda=_BH_LAMBDA, minChildWeight=1.0)
    found = bins.find_bins(df.select("features"), "features", 64, True)
    fit = boost.Fit(df, found, "reg:squarederror", 1, [boost.Spec(est.rule(), 1, None, np.zeros(1))], "spark")
    sums, grower = _root_sums(fit)
    return boost.searched(sums, fit.bins, [grower.rule]).select("split.*").select(F.col("feat").alias("category"), F.col("hl").alias("h_with"), F.col("hr").alias("h_without"), rnd("gain").alias("gain"))


_EDGE_BINS = 8
_EDGE_WEIGHT = f"({sg.d(1.0)} / ({sg.d(1.0)} + exp(-(f0 * {sg.d(4.0)} - f1 * {sg.d(3.0)}))))"
_EDGE_ROWS = " UNION ALL ".join(f"SELECT CAST({j} AS INTEGER) AS feat_id, f{j} AS x, {_EDGE_WEIGHT} * ({sg.d(1.0)} - {_EDGE_WEIGHT}) AS w FROM ({D_PLANT}) A" for j in range(3))


@register("boost_weighted_edges", f"""
WITH V AS (SELECT feat_id, x, sum(w) AS w FROM ({_EDGE_ROWS}) u GROUP BY feat_id, x),
C AS (SELECT feat_id, x, w, sum(w) OVER (PARTITION BY feat_id ORDER BY x) AS upto, sum(w) OVER (PARTITION BY feat_id) AS total FROM V),
R AS (SELECT feat_id, x, floor(upto * {_EDGE_BINS} / total + 1e-9::DOUBLE) AS hi, floor((upto - w) * {_EDGE_BINS} / total + 1e-9::DOUBLE) AS lo FROM C)
SELECT feat_id, row_number() OVER (PARTITION BY feat_id ORDER BY x) AS edge, x AS threshold FROM R WHERE hi > lo AND lo < {_EDGE_BINS} - 1""")
def q_boost_weighted_edges(spark, sf_dir):
    """Bin edges by hessian weight p (1 - p) of a logistic score, from the mergeable weighted summary."""
    from ..operators import bins
    f = F.col("features")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(f[0] * 4.0 - f[1] * 3.0)))
    df = fx.lineitem_design(spark, sf_dir).select(F.slice("features", 1, 3).alias("x"), (p * (F.lit(1.0) - p)).alias("w"))
    found = bins.edges(df, "x", 3, _EDGE_BINS, weight="w")
    return found.select(F.col("feat").alias("feat_id"), F.posexplode("edges").alias("edge", "threshold")).select("feat_id", (F.col("edge") + 1).cast("long").alias("edge"), "threshold")

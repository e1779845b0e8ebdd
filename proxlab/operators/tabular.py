"""Tabular learning (T1-T19, S8, S9): one parameterized pipeline for every dataset x learner.

train -> [label indexer] ++ category indexers ++ one-hot ++ assembler ++ learner
      -> 3 folds by key hash: preparation fitted once per fold, one fit for all depths of a tree or forest, in parallel as memory allows;
         boosted trees grow in common passes for all folds and depths (boost, gbt)
      -> best model saved (overwrite) and reloaded -> held-out predictions (cached once)
      -> every metric from one aggregation over those predictions.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, spread
from . import boost, gbt, metrics, prep

FOLD_COL = "_fold"
#: learners whose tree of a smaller depth is the upper part of the deeper one
GREEDY = (DecisionTreeClassifier, DecisionTreeRegressor, RandomForestClassifier, RandomForestRegressor)


@dataclass
class TabularResult:
    metrics: dict
    avg_metrics: list
    grid: list
    best_params: dict
    model_path: str


def learner(kind: str, task: str, **params):
    """Learner by family ('dt', 'rf', 'gbt', 'xgb', 'lgbm') and task ('binary', 'multi', 'regression')."""
    if kind == "xgb":
        obj = {"binary": "binary:logistic", "multi": "multi:softprob", "regression": "reg:squarederror"}[task]
        return boost.xgboost_like(obj, **params)
    if kind == "lgbm":
        obj = {"binary": "binary:logistic", "multi": "multi:softprob", "regression": "reg:squarederror"}[task]
        return boost.lightgbm_like(obj, **params)
    cls = {("dt", False): DecisionTreeClassifier, ("dt", True): DecisionTreeRegressor,
           ("rf", False): RandomForestClassifier, ("rf", True): RandomForestRegressor,
           ("gbt", False): GBTClassifier, ("gbt", True): GBTRegressor}[(kind, task == "regression")]
    return cls(labelCol="label", featuresCol="features", **params)


def evaluator(task: str):
    """Selection metric: AUC from the hard prediction column (binary), F1 (multi), RMSE (regression)."""
    if task == "binary":
        return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="prediction",
                                            metricName="areaUnderROC")
    if task == "multi":
        return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")
    return RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse")


def build_grid(est, grid: dict) -> list:
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(est.getParam(name), list(values))
    return b.build()


def train_tabular(df: DataFrame, label: str, kind: str, task: str, grid: dict, key: str,
                  split_seed: int = 0, fold_seed: int = 0, num_folds: int = 3, parallelism: int | None = None,
                  learner_params: dict | None = None, drop: list[str] = (), model_path: str | None = None
                  ) -> tuple[TabularResult, DataFrame]:
    """Fit with cross-validation on the 80 % key-hash split; score the reloaded best model on the rest.

    Returns the result summary and the cached held-out predictions ``[label, prediction]``.
    """
    spark = df.sparkSession
    data = df.drop(*drop).na.drop("any")
    roles = prep.column_roles(data.schema, label, exclude=[key])
    index_label = task != "regression"
    stages = prep.feature_stages(data, roles, index_label=index_label)
    if index_label:
        # the label indexer writes label_idx; the learners read "label"
        data = data.withColumnRenamed(label, "_label_raw")
        stages[0].setInputCol("_label_raw").setOutputCol("label")
    else:
        data = data.withColumn("label", F.col(label).cast("double"))
        if label != "label":
            data = data.drop(label)
    est = learner(kind, task, **(learner_params or {}))
    param_grid = build_grid(est, grid)
    data = data.withColumn(FOLD_COL, prep.key_hash(key, num_folds, fold_seed + 17).cast("int"))
    is_train = prep.hash_split_col(key, 80, split_seed)
    train = spread(data.filter(is_train)).persist(StorageLevel.MEMORY_AND_DISK)
    test = data.filter(~is_train)
    parallelism = parallelism or max(1, min(8, len(param_grid) * num_folds))
    try:
        together = None
        if isinstance(est, boost.HistBoost) or gbt.served([est.copy(p) for p in param_grid]):
            # the preparation sees no label; all folds, grid points and the models of all rows grow together
            prefix, features = prepared(Pipeline(stages=stages), train, [train], FOLD_COL)
            points = [est.copy(p) for p in param_grid]
            together = (boost.tuned(features[0], FOLD_COL, points, num_folds, task) if isinstance(est, boost.HistBoost)
                        else gbt.tuned(features[0], FOLD_COL, points, num_folds, evaluator(task)))
            features[0].unpersist()
        if together:
            avg, models = together
            model = models[_argbest(avg, task)]
        else:
            avg = cross_validate(train, Pipeline(stages=stages), est, param_grid, evaluator(task), num_folds, parallelism)
            # one fit reads the features, and holds the points that it makes of them
            prefix = Pipeline(stages=stages).fit(train)
            model = est.copy(param_grid[_argbest(avg, task)]).fit(prefix.transform(train).select("label", "features"))
    finally:
        train.unpersist()
    best = PipelineModel([*prefix.stages, model])
    path = model_path or scratch_path(spark, f"model-{kind}-{task}")
    best.write().overwrite().save(path)                       # S8
    loaded = PipelineModel.load(path)                         # S9
    pred = loaded.transform(test).select(F.col("label").cast("double").alias("label"),
                                         F.col("prediction").cast("double").alias("prediction"))
    pred = pred.persist(StorageLevel.MEMORY_AND_DISK)
    m = evaluate(pred, task)
    best_params = {p.name: v for p, v in param_grid[_argbest(avg, task)].items()}
    return TabularResult(m, avg, [{p.name: v for p, v in g.items()} for g in param_grid],
                         best_params, path), pred


def prepared(pipe: Pipeline, fit_on: DataFrame, frames: list[DataFrame], *more: str) -> tuple[PipelineModel, list[DataFrame]]:
    """The fitted preparation stages, and the frames through them as persisted ``[label, features, more...]``."""
    model = pipe.fit(fit_on)
    return model, [model.transform(f).select("label", "features", *more).persist(StorageLevel.MEMORY_AND_DISK) for f in frames]


def cross_validate(train: DataFrame, pipe: Pipeline, est, param_grid: list, judge, num_folds: int, parallelism: int) -> list[float]:
    """Mean metric of every grid point (T16).  The preparation is fitted once per fold.  Trees and forests that differ in
    depth only are one fit of the deepest, cut to the other depths; a fold's features are persisted only where several fits
    read them.  As many fits run at a time as the executors' memory holds the points of."""
    runs = depth_runs(est, param_grid)
    fits = [(fold, run) for fold in range(num_folds) for run in runs]
    folds = []
    for fold in range(num_folds):
        inside = F.col(FOLD_COL) != fold
        rest = train.filter(inside)
        model = pipe.fit(rest)
        folds.append([model.transform(f).select("label", "features") for f in (rest, train.filter(~inside))])
    rows = train.count()
    some = folds[0][0].select("features").first()
    width = len(some[0]) if some else 1
    at_once = max(1, min(parallelism, storage_left(train.sparkSession) // (rows * point_bytes(est, param_grid, width) + 1)))
    # fits of the same fold run together, so that only their features are held
    ahead = max(1, at_once // len(runs))
    scores = {}

    def one(fit):
        fold, run = fit
        models = depths(est.copy(param_grid[run[-1]]).fit(folds[fold][0]), [param_grid[i] for i in run], est)
        return judged(judge, models, folds[fold][1])

    for first in range(0, num_folds, ahead):
        now = [fit for fit in fits if first <= fit[0] < first + ahead]
        held = [f for fold in range(first, min(first + ahead, num_folds)) for f in folds[fold]] if len(runs) > 1 else []
        for f in held:
            f.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with ThreadPool(min(at_once, len(now))) as pool:
                for (fold, run), values in zip(now, pool.map(inheritable_thread_target(train.sparkSession)(one), now), strict=True):
                    scores.update({(i, fold): v for i, v in zip(run, values, strict=True)})
        finally:
            for f in held:
                f.unpersist()
    return [sum(scores[i, fold] for fold in range(num_folds)) / num_folds for i in range(len(param_grid))]


def depth_runs(est, param_grid: list) -> list[list[int]]:
    """Grid points in groups that one fit serves, the deepest last: those of a tree or forest that differ in depth only."""
    if not isinstance(est, GREEDY):
        return [[i] for i in range(len(param_grid))]
    runs: dict = {}
    for i, p in enumerate(param_grid):
        runs.setdefault(tuple(sorted((k.name, repr(v)) for k, v in p.items() if k.name != "maxDepth")), []).append(i)
    depth = [est.copy(p).getOrDefault("maxDepth") for p in param_grid]
    return [sorted(run, key=lambda i: depth[i]) for run in runs.values()]


def depths(deepest, grid_points: list, est) -> list:
    """The models of grid points that differ in depth only, the last of which is the deepest, already fitted."""
    return [*(cut(deepest, est.copy(p).getOrDefault("maxDepth")) for p in grid_points[:-1]), deepest]


def cut(model, depth: int):
    """A fitted tree or forest as the same fit gives it with maxDepth = ``depth``.

    Trees grow level by level and a split depends on its node's rows only (in a forest also on draws in the order of the
    nodes), so what is deeper changes nothing above.  Leaves that predict the same are merged as Spark merges them.
    """
    spark = SparkSession.active()
    ml = spark._jvm.org.apache.spark.ml

    def cut_node(node, left: int):
        if not node.subtreeDepth():
            return node
        here = node.prediction(), node.impurity(), node.impurityStats()
        if left:
            a, b = cut_node(node.leftChild(), left - 1), cut_node(node.rightChild(), left - 1)
            if a.subtreeDepth() or b.subtreeDepth() or a.prediction() != b.prediction():
                return ml.tree.InternalNode(here[0], here[1], node.gain(), a, b, node.split(), here[2])
        return ml.tree.LeafNode(*here)

    def cut_tree(tree):
        kind = getattr(getattr(ml, family), type(model).__name__.replace("RandomForest", "DecisionTree"))
        root = cut_node(tree.rootNode(), depth)
        return kind(tree.uid(), root, tree.numFeatures(), *([tree.numClasses()] if family == "classification" else []))

    java = model._java_obj
    family = "classification" if hasattr(model, "numClasses") else "regression"
    if not hasattr(model, "trees"):
        out = cut_tree(java)
    else:
        trees = java.trees()
        array = spark.sparkContext._gateway.new_array(getattr(getattr(ml, family), type(model).__name__.replace("RandomForest", "DecisionTree")), len(trees))
        for i, t in enumerate(trees):
            array[i] = cut_tree(t)
        kind = getattr(getattr(ml, family), type(model).__name__)
        out = kind(java.uid(), array, java.numFeatures(), *([java.numClasses()] if family == "classification" else []))
    return type(model)(java.copyValues(out, ml.param.ParamMap()))


def judged(judge, models: list, held_out: DataFrame) -> list[float]:
    """The metric of each model on the held-out rows.  Classes are counted by label and predictions of all models in one pass;
    the judge then weighs what is left, a row per combination."""
    if isinstance(judge, RegressionEvaluator):
        return [judge.evaluate(m.transform(held_out)) for m in models]
    pred = held_out
    names = [f"_p{i}" for i in range(len(models))]
    for name, m in zip(names, models):
        pred = m.copy({m.predictionCol: name, m.rawPredictionCol: "", m.probabilityCol: ""}).transform(pred)
    cells = pred.groupBy("label", *names).agg(F.count(F.lit(1)).cast("double").alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [judge.copy({judge.weightCol: "_n"}).evaluate(cells.select("label", F.col(name).alias("prediction"), "_n")) for name in names]
    finally:
        cells.unpersist()


def point_bytes(est, param_grid: list, width: int) -> int:
    """About what a learner holds of a row while it fits: binned features, and a count for each tree of a forest."""
    trees = max(est.copy(p).getNumTrees() for p in param_grid) if hasattr(est, "getNumTrees") else 1
    return 120 + 4 * width + 4 * trees


def storage_left(spark: SparkSession) -> int:
    """Bytes that the executors' block managers can still hold (on a cluster without the driver's)."""
    it = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator()
    left = []
    while it.hasNext():
        left.append(int(it.next()._2()))
    return sum(sorted(left)[:-1]) if len(left) > 1 else sum(left)


def _argbest(vals, task):
    return min(range(len(vals)), key=vals.__getitem__) if task == "regression" else \
        max(range(len(vals)), key=vals.__getitem__)


def evaluate(pred: DataFrame, task: str) -> dict:
    """All report metrics for the task from the cached predictions."""
    if task == "regression":
        return metrics.regression_metrics(pred).first().asDict()
    out = metrics.multiclass_metrics(pred).first().asDict()
    if task == "binary":
        areas = metrics.binary_areas(metrics.binary_points(pred, "prediction", "label")).first()
        out["auc_roc_hard"] = areas["auc_roc"]
        out["auc_pr_hard"] = areas["auc_pr"]
    return out


def baseline(df: DataFrame, label: str, key: str, task: str, split_seed: int = 0, drop: list[str] = ()) -> dict:
    """n_train, n_test and what the constant prediction learned from the training rows reaches on the test rows: accuracy of
    their most frequent class (the smallest of equally frequent ones), or root mean squared error of their mean."""
    data = df.drop(*drop).na.drop("any").select(F.col(label).alias("y"), prep.hash_split_col(key, 80, split_seed).alias("train"))
    if task == "regression":
        # squares about the training mean, from sums about any number: the mean of all rows keeps them accurate
        mean = data.where("train").agg(F.avg("y")).first()[0]
        r = data.agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"),
                     F.sqrt(F.avg(F.when(~F.col("train"), (F.col("y") - F.lit(mean)) ** 2))).alias("baseline")).first()
        return r.asDict()
    count = {(r["train"], r["y"]): r["count"] for r in data.groupBy("train", "y").count().collect()}
    n = {side: sum(c for (t, _), c in count.items() if t == side) for side in (True, False)}
    best = min((y for t, y in count if t), key=lambda y: (-count[True, y], y))
    return {"n_train": n[True], "n_test": n[False], "baseline": count.get((False, best), 0) / max(1, n[False])}


def beats(metrics: dict, base: dict, task: str) -> bool:
    return metrics["rmse"] < base["baseline"] if task == "regression" else metrics["accuracy"] > base["baseline"]


def metrics_df(spark: SparkSession, res: TabularResult) -> DataFrame:
    schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
    rows = [(k, None if v is None else float(v)) for k, v in sorted(res.metrics.items())]
    return spark.createDataFrame(rows, schema)


def cv_df(spark: SparkSession, res: TabularResult) -> DataFrame:
    schema = T.StructType([T.StructField("grid_index", T.IntegerType()), T.StructField("params", T.StringType()),
                           T.StructField("avg_metric", T.DoubleType())])
    rows = [(i, str(sorted(g.items())), float(v)) for i, (g, v) in enumerate(zip(res.grid, res.avg_metrics))]
    return spark.createDataFrame(rows, schema)

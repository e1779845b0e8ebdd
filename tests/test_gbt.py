"""Boosted variance trees grown together for all folds and depths: pyspark.ml's models, fold by fold."""

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import functions as F

from proxlab.operators import gbt, tabular


def _rows(spark, n=900):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(n, 2))
    kind = rng.integers(0, 3, n)
    score = X[:, 0] * X[:, 1] + 0.7 * (kind == 1) + 0.5 * rng.normal(size=n)
    rows = [(*map(float, x), float(k), float(s > 0.2), float(s), int(i % 3)) for i, (x, k, s) in enumerate(zip(X, kind, score))]
    df = spark.createDataFrame(rows, "a double, b double, kind double, class double, score double, fold int")
    df = OneHotEncoder(inputCols=["kind"], outputCols=["kind_vec"], dropLast=False).fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "kind_vec", "b"], outputCol="features").transform(df).repartition(3).persist()


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_models_grown_together_are_those_of_single_fits(spark, task):
    data = _rows(spark).withColumn("label", F.col("class" if task == "binary" else "score"))
    est, judge = tabular.learner("gbt", task, maxIter=5), tabular.evaluator(task)
    points = [est.copy({est.maxDepth: depth}) for depth in (2, 0, 4)]
    averages, models = gbt.tuned(data, "fold", points, 3, judge)
    for i, p in enumerate(points):
        want = [judge.evaluate(p.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))) for f in range(3)]
        assert averages[i] == pytest.approx(sum(want) / 3, rel=5e-3)
        col = "prediction" if task == "regression" else "probability"
        a, b = (np.array([np.ravel(r[0]) for r in m.transform(data).select(col).collect()]) for m in (p.fit(data), models[i]))
        # in the smallest nodes splits may gain the same but for rounding
        assert np.quantile(abs(a - b), 0.9) < 1e-9 and abs(a - b).max() < (1e-9 if i < 2 else 0.2)


def test_cut_state_and_small_blocks_do_not_change_the_models(spark, monkeypatch):
    data = _rows(spark).withColumn("label", F.col("class"))
    est = tabular.learner("gbt", "binary", maxIter=5, maxDepth=3)
    preds = []
    for cut, block, exact, direct in ((2, 64, 0, 0), (100, 1 << 15, 1 << 30, 1 << 30)):
        for name, v in (("CUT_ROUNDS", cut), ("BLOCK_ROWS", block), ("EXACT_ROWS", exact), ("DIRECT_COLLECT_MAX", direct)):
            monkeypatch.setattr(gbt, name, v)
        _, (model,) = gbt.tuned(data, "fold", [est], 3, tabular.evaluator("binary"))
        preds.append([r[0][1] for r in model.transform(data).select("probability").collect()])
    assert np.allclose(*preds)


def test_folds_and_depths_are_not_fitted_one_by_one(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    def one_by_one(self, *a):
        raise AssertionError("a fit of its own")

    monkeypatch.setattr(GBTClassifier, "fit", one_by_one)
    df = spark.createDataFrame([(i, float(i * 37 % 100), "yes" if i * 37 % 100 > 40 else "no") for i in range(600)], "id long, x double, y string")
    res, pred = tabular.train_tabular(df, "y", "gbt", "binary", {"maxIter": [4], "maxDepth": [1, 3], "impurity": ["variance"]}, "id")
    pred.unpersist()
    assert len(res.avg_metrics) == 2 and res.metrics["accuracy"] > 0.95


def test_what_is_not_done_here_is_left_to_single_fits(spark):
    data = _rows(spark).withColumn("label", F.col("class"))
    judge = tabular.evaluator("binary")
    for params in ({"subsamplingRate": 0.5}, {"featureSubsetStrategy": "sqrt"}, {"maxDepth": 30}):
        assert gbt.tuned(data, "fold", [tabular.learner("gbt", "binary", **params)], 3, judge) is None
    with pytest.raises(ValueError, match="labels 0 and 1"):
        gbt.tuned(data.withColumn("label", F.col("label") + 1), "fold", [tabular.learner("gbt", "binary")], 3, judge)


def test_thresholds_are_midpoints_or_share_the_rows():
    assert gbt.midpoints(np.array([0.0, 1.0, 4.0]), np.array([5, 1, 1]), 3).tolist() == [0.5, 2.5]
    assert gbt.midpoints(np.arange(8.0), np.ones(8, int), 3).tolist() == [1.5, 3.5, 5.5]

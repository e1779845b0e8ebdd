"""Booster parts: quantile summary within its bound, bundles, sparse rows, split search in Spark, common fits, node table."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from proxlab.operators import bins, boost


def vectors(X, sparse):
    for x in X:
        at = np.flatnonzero((x != 0) | np.isnan(x))
        yield Vectors.sparse(len(x), at.tolist(), x[at].tolist()) if sparse else Vectors.dense(x.tolist())


def frame(spark, X, y, sparse=False, parts=3):
    fold = [i % 3 for i in range(len(y))]
    return spark.createDataFrame(list(zip(vectors(X, sparse), map(float, y), fold)), ["features", "label", "fold"]).repartition(parts).persist()


@pytest.fixture(scope="module")
def mixed():
    """Two numeric columns (zeros and missing values among them), a one-hot group of 6, a column of few values."""
    rng = np.random.default_rng(8)
    n = 600
    num = rng.normal(size=(n, 2)).round(2)
    num[rng.random((n, 2)) < 0.15] = 0.0
    num[rng.random((n, 2)) < 0.1] = np.nan
    group = np.zeros((n, 6))
    kind = rng.integers(0, 7, n)
    group[np.arange(n)[kind < 6], kind[kind < 6]] = 1.0
    X = np.c_[num, group, rng.integers(-1, 3, n)]
    y = np.nan_to_num(X[:, 0]) * 2 + (kind == 2) * 3 - (kind == 6) + X[:, 8] + 0.1 * rng.normal(size=n)
    return X, y


# ---- quantile summary -----------------------------------------------------------------------------

def weight_upto(value, weight, x):
    return weight[value <= x].sum()


@pytest.mark.parametrize("heavy", [False, True])
def test_pruned_points_stay_within_the_bound(heavy):
    rng = np.random.default_rng(1)
    value, weight = rng.normal(size=5000), rng.random(5000)
    if heavy:
        weight[rng.integers(0, 5000, 20)] = 400.0
    parts = [(np.zeros(1000, np.int64), value[i::5], weight[i::5], np.zeros(1000, np.int64)) for i in range(5)]
    size = 64
    once = [bins.compressed(*p, size) for p in parts]
    f, v, w, prunes = bins.compressed(*(np.concatenate(x) for x in zip(*once)), size)
    assert len(v) <= 4 * size and abs(w.sum() - weight.sum()) < 1e-6 and 1 <= prunes.max() <= 2
    worst = max(abs(weight_upto(value, weight, x) - weight_upto(v, w, x)) for x in np.r_[v, rng.normal(size=300)])
    assert worst <= prunes.max() * weight.sum() / size


def test_edges_within_the_bound_of_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    n = 6000
    X = np.c_[rng.normal(size=n), rng.exponential(size=n).round(1), np.where(rng.random(n) < 0.7, 0.0, rng.integers(1, 4, n))]
    X[rng.random(n) < 0.05, 0] = np.nan
    w = rng.random(n)
    df = spark.createDataFrame([(x.tolist(), float(v)) for x, v in zip(X, w)], "features array<double>, w double").repartition(7)
    size, most = 128, 16
    got = {r.feat: r for r in bins.edges(df, "features", 3, most, weight="w", size=size, final_points=1200).collect()}
    for j in range(3):
        good = ~np.isnan(X[:, j])
        v, wt = X[good, j], w[good]
        assert abs(got[j].weight - wt.sum()) < 1e-6
        if len(np.unique(v)) < most:
            assert got[j].edges == np.unique(v).tolist()
            continue
        assert len(got[j].edges) <= most - 1 and set(got[j].edges) <= set(v)
        assert got[j].prunes >= (j == 0)
        bound = got[j].prunes * wt.sum() / size + 1e-9
        for want in wt.sum() * np.arange(1, most) / most:
            assert any(wt[v < e].sum() - bound <= want <= weight_upto(v, wt, e) + bound for e in got[j].edges)
    zero = bins.edges(df, "features", 3, most, zero_missing=True, weight="w", size=size).where("feat = 2").first()
    assert zero.edges == [1.0, 2.0, 3.0]


# ---- bundles and sparse rows ----------------------------------------------------------------------

def test_bundles_are_the_fewest_exclusive_runs(spark, mixed):
    X, y = mixed
    df = frame(spark, X, y, sparse=True)
    assert bins.bundle_starts(df, "features", 9).tolist() == [0, 1, 2, 8]
    for row, starts in (([[1, 0, 2], [0, 3, 0]], [0, 2]), ([[1, 0], [0, 2]], [0]), ([[1, 2, 3]], [0, 1, 2]), ([[0, 0, 0]], [0])):
        some = spark.createDataFrame([([float(v) for v in r],) for r in row], "features array<double>")
        assert bins.bundle_starts(some, "features", len(row[0])).tolist() == starts
    b = bins.find_bins(df.select("features"), "features", 64, False)
    assert b.width == 4 and b.n == 9


def test_rows_of_codes(spark, mixed):
    X, y = mixed
    b = bins.find_bins(frame(spark, X, y).select("features"), "features", 64, False)
    col = pa.array([[None if np.isnan(v) else float(v) for v in x] for x in X[:50]], pa.list_(pa.float64()))
    codes = b.rows(col)
    for x, c in zip(X[:50], codes):
        for j in range(9):
            place = 0 if np.isnan(x[j]) else int(np.searchsorted(b.edges[j], x[j])) + 1
            own = c[b.bundle[j]] - 1 - b.start[j]
            assert (own == place) if 0 <= own < b.start[j + 1] - b.start[j] else (place == b.default[j])


def test_sparse_and_dense_vectors_give_one_model(spark, mixed):
    X, y = mixed
    preds = []
    for sparse in (False, True):
        df = frame(spark, X, y, sparse)
        for zero in (False, True):
            est = boost.HistBoost(objective="reg:squarederror", numRound=3, maxDepth=4, zeroAsMissing=zero)
            model = est.fit(df)
            other = frame(spark, X, y, not sparse)
            a, b = (model.transform(d).groupBy("label").agg(F.first("prediction").alias("p")).orderBy("label").toPandas().p for d in (df, other))
            assert np.allclose(a, b)
            preds.append(a)
    assert np.allclose(preds[0], preds[2]) and np.allclose(preds[1], preds[3]) and not np.allclose(preds[0], preds[1])


def test_wide_category_column_trains_from_sparse_rows(spark):
    from pyspark.ml.feature import OneHotEncoder
    n = 100_000
    df = spark.range(20_000).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("k"), (F.col("id") % 5).cast("double").alias("x"))
    df = df.withColumn("label", F.when(F.col("k") == 7919.0 * 3, 900.0).otherwise(F.col("x")))
    last = spark.createDataFrame([(n - 1.0, 0.0, 0.0)], "k double, x double, label double")
    df = OneHotEncoder(inputCols=["k"], outputCols=["features"], dropLast=False).fit(df.unionByName(last)).transform(df)
    model = boost.xgboost_like("reg:squarederror", numRound=2, maxDepth=2, eta=1.0, regLambda=0.0).fit(df)
    nodes = model.nodes.to_pandas()
    assert nodes[(nodes.tree == 0) & (nodes.node == 0)].feature.tolist() == [7919 * 3]
    assert abs(model.transform(df.where("label = 900")).first().prediction - 900) < 1
    with pytest.raises(Exception, match="width|vector of"):
        model.transform(spark.createDataFrame([(Vectors.dense([1.0]),), (Vectors.dense([1.0, 2.0]),)], ["features"])).collect()


# ---- split search and common fits -----------------------------------------------------------------

@pytest.mark.parametrize("objective,growth", [("reg:squarederror", "depth"), ("reg:squarederror", "leaf"), ("binary:logistic", "depth"), ("multi:softprob", "leaf")])
def test_search_in_spark_equals_the_driver(spark, mixed, monkeypatch, objective, growth):
    X, y = mixed
    label = y if objective.startswith("reg") else (y > 1) if objective.startswith("binary") else np.digitize(y, [0, 2])
    df = frame(spark, X, label, sparse=True)
    tables = []
    for search, dense in (("driver", True), ("spark", True), ("spark", False)):
        monkeypatch.setattr(boost, "TASK_CELLS", 1 << 30 if dense else 0)
        est = boost.HistBoost(objective=objective, numRound=2, maxDepth=3, growth=growth, numLeaves=6, splitSearch=search, minChildWeight=0.5, regAlpha=0.1)
        tables.append(est.fit(df).nodes.to_pandas())
    for t in tables[1:]:
        assert (t.feature == tables[0].feature).all() and np.allclose(t.threshold, tables[0].threshold) and np.allclose(t.value, tables[0].value)
    # a fit whose passes outgrow the driver on the way
    monkeypatch.setattr(boost, "DRIVER_CELLS", 400)
    t = boost.HistBoost(objective=objective, numRound=2, maxDepth=3, growth=growth, numLeaves=6, minChildWeight=0.5, regAlpha=0.1).fit(df).nodes.to_pandas()
    assert np.allclose(t.value, tables[0].value)


def test_models_grown_together_equal_separate_fits(spark, mixed):
    X, y = mixed
    df = frame(spark, X, y, sparse=True)
    points = [boost.HistBoost(objective="reg:squarederror", numRound=r, maxDepth=d, maxBins=600, minChildWeight=20.0, boostFromAverage=True) for r, d in ((2, 2), (3, 4))]
    models, fit = boost.fit_many(df, [(p, f) for p in points for f in (0, None)], "fold")
    scores = boost.fold_scores(fit, "regression")
    passes = fit.passes
    fit.close()
    assert sorted(scores) == [0, 2] and passes <= 3 * 4
    for i, (p, f) in enumerate([(p, f) for p in points for f in (0, None)]):
        if f is None:
            a, b = (m.transform(df).groupBy("label").agg(F.first("prediction").alias("p")).orderBy("label").toPandas().p for m in (p.fit(df), models[i]))
            assert np.allclose(a, b)
        else:
            held = df.where("fold = 0")
            want = models[i].transform(held).select(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0]
            assert abs(scores[i] - want) < 1e-9
    with pytest.raises(ValueError, match="share"):
        boost.fit_many(df, [(points[0], None), (boost.HistBoost(objective="binary:logistic"), None)], "fold")


def test_hard_scores_equal_the_evaluators(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    rng = np.random.default_rng(5)
    for k, mine, judge in ((2, boost._hard_auc, BinaryClassificationEvaluator(rawPredictionCol="prediction")), (4, boost._weighted_f1, MulticlassClassificationEvaluator(metricName="f1"))):
        y, p = rng.integers(0, k, 300), rng.integers(0, k, 300)
        df = spark.createDataFrame(pd.DataFrame({"label": y.astype(float), "prediction": p.astype(float)}))
        cells = {(float(a), float(b)): int(((y == a) & (p == b)).sum()) for a in range(k) for b in range(k) if ((y == a) & (p == b)).any()}
        assert abs(judge.evaluate(df) - mine(cells)) < 1e-9


# ---- the node table -------------------------------------------------------------------------------

def test_a_thousand_trees_save_load_and_score(spark, tmp_path, mixed):
    X, y = mixed
    df = frame(spark, X, y, sparse=True)
    few = boost.HistBoost(objective="reg:squarederror", numRound=4, maxDepth=4).fit(df)
    trees = [few.nodes.filter(pa.compute.equal(few.nodes["tree"], i)) for i in range(4)]
    many = pa.concat_tables([t.set_column(1, "tree", pa.array([i] * t.num_rows, pa.int32())) for i in range(1000) for t in [trees[i % 4]]])
    model = boost.HistBoostModel(objective="reg:squarederror", base=[1.5]).with_nodes(many)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = boost.HistBoostModel.load(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "nodes")).count() == many.num_rows
    a, b, one = ({r.label: r.prediction for r in m.transform(df).collect()} for m in (model, again, few))
    assert a == b and all(abs(a[k] - (250 * one[k] + 1.5)) < 1e-6 for k in one)
    empty = boost.HistBoost(objective="reg:squarederror", numRound=1, minChildWeight=1e9).fit(df)
    assert empty.transform(df).select("prediction").distinct().count() == 1


def test_bad_parameters(spark, mixed):
    df = frame(spark, *mixed)
    for kw in ({"maxBins": 1}, {"maxBins": 1 << 21}, {"objective": "rank"}):
        with pytest.raises(ValueError):
            boost.HistBoost(numRound=1, **{"objective": "reg:squarederror", **kw}).fit(df)
    with pytest.raises(ValueError, match="empty"):
        boost.HistBoost(numRound=1).fit(df.limit(0))


def test_trees_reach_their_depth(spark):
    rows = [([float(i % 2), float(i // 2 % 2), float(i // 4 % 2)], float(i % 8)) for i in range(64)]
    df = spark.createDataFrame(rows, "features array<double>, label double")
    for depth in (1, 2, 3):
        model = boost.HistBoost(objective="reg:squarederror", numRound=1, maxDepth=depth, eta=1.0, regLambda=0.0).fit(df)
        assert model.transform(df).select("prediction").distinct().count() == 2 ** depth


def test_edges_of_many_features_are_one_array():
    import pickle
    rng = np.random.default_rng(8)
    lists = [np.unique(rng.integers(-3, 9, rng.integers(0, 6)) / 2) for _ in range(500)]
    b = bins.FeatureBins.of(lists, np.zeros(1, np.int64), False)
    feat, value = rng.integers(0, 500, 4000), rng.integers(-4, 10, 4000) / 2
    assert (b.edges.below(feat, value) == [np.searchsorted(lists[f], v) for f, v in zip(feat, value)]).all()
    assert (b.default == [np.searchsorted(e, 0.0) + 1 for e in lists]).all() and all((x == y).all() for x, y in zip(b.edges, lists, strict=True))
    # a one-hot column costs some numbers in a task, not an object
    assert len(pickle.dumps(bins.FeatureBins.of([np.ones(1)] * 20000, np.zeros(1, np.int64), True))) < 20000 * 60


def test_equal_entries_of_a_task_are_put_together_before_they_are_summarized(monkeypatch):
    held = []
    monkeypatch.setattr(bins, "MERGE_ENTRIES", 1000)
    plain = bins.compressed
    monkeypatch.setattr(bins, "compressed", lambda f, *rest: held.append(len(f)) or plain(f, *rest))

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            one = pa.RecordBatch.from_arrays([pa.array([[float(1 + i % 7), float(1 + i % 3)] for i in range(500)])], names=["features"])
            return list(run(iter([one] * 40)))

    (out,) = bins.summary(Rows(), "features", 2)
    assert max(held) <= 40 * 10 and out.num_rows == 10 and sum(out["weight"].to_pylist()) == 40 * 1000


def test_paths_of_binned_rows(monkeypatch):
    rng = np.random.default_rng(9)
    b = bins.FeatureBins.of([np.arange(1.0, 6.0), np.arange(-2.0, 3.0), np.ones(1)], np.array([0, 1]), False)
    t = {"feature": [0, 1, 2, -1, -1, -1, -1], "bin": [3, 2, 1, 0, 0, 0, 0], "default_left": [True, False, False, True, True, True, True],
         "left": [1, 3, 5, -1, -1, -1, -1], "right": [2, 4, 6, -1, -1, -1, -1], "value": [0.0] * 7}
    t = {k: np.array(v) for k, v in t.items()}
    codes = np.stack([rng.integers(0, b.start[1] + 1, 400), np.where(rng.random(400) < 0.3, 0, rng.integers(b.start[1] + 1, b.codes + 1, 400))], axis=1)

    def walked(row):
        node = 0
        while t["feature"][node] >= 0:
            f = t["feature"][node]
            place = row[b.bundle[f]] - 1 - b.start[f]
            place = place if 0 <= place < b.start[f + 1] - b.start[f] else b.default[f]
            node = t["left" if (t["default_left"][node] if place == 0 else place <= t["bin"][node]) else "right"][node]
        return node

    want = [walked(r) for r in codes]
    assert len(set(want)) == 4 and (boost.Path(t, b).leaves(codes) == want).all()
    monkeypatch.setattr(boost, "SIDE_CELLS", 0)
    path = boost.Path(t, b)
    assert path.side is None and (path.leaves(codes) == want).all()

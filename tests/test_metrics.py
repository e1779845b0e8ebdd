"""Evaluation: distributed scan == pandas cumsum; AUC == pairwise brute force; edge cases."""

import numpy as np
import pandas as pd
import pytest

from proxlab.operators import metrics as M


def brute_auc(scores, labels):
    pos = scores[labels == 1]
    neg = scores[labels == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_prefix_sums_match_pandas(spark, parts):
    rng = np.random.default_rng(parts)
    pdf = pd.DataFrame({"k": rng.permutation(500).astype(float), "v": rng.integers(0, 9, 500).astype(np.int64)})
    df = spark.createDataFrame(pdf).repartition(parts)
    out = M.prefix_sums(df, "k", ["v"], descending=True, num_partitions=parts).toPandas().sort_values("k")
    ref = pdf.sort_values("k", ascending=False).assign(c=lambda d: d["v"].cumsum()).sort_values("k")
    assert out["cum_v"].tolist() == ref["c"].tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_auc_matches_pairwise(spark, seed):
    rng = np.random.default_rng(seed)
    s = np.round(rng.normal(size=400), 1)          # many ties
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * s))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "label": y}))
    got = M.binary_areas(M.binary_points(df, "score", "label")).first()["auc_roc"]
    assert abs(got - brute_auc(s, y)) < 1e-12


def test_auc_edge_cases(spark):
    one_class = spark.createDataFrame(pd.DataFrame({"score": [0.1, 0.2], "label": [1.0, 1.0]}))
    r = M.binary_areas(M.binary_points(one_class, "score", "label")).first()
    assert r["auc_roc"] is None and r["auc_pr"] is None
    equal = spark.createDataFrame(pd.DataFrame({"score": [0.5] * 4, "label": [1.0, 0.0, 1.0, 0.0]}))
    r = M.binary_areas(M.binary_points(equal, "score", "label")).first()
    assert abs(r["auc_roc"] - 0.5) < 1e-12 and abs(r["auc_pr"] - 0.5) < 1e-12


def test_multiclass_weighted(spark):
    pdf = pd.DataFrame({"label": [0, 0, 1, 1, 2, 2, 2], "prediction": [0, 1, 1, 1, 2, 0, 2]}).astype(float)
    r = M.multiclass_metrics(spark.createDataFrame(pdf)).first()
    assert abs(r["accuracy"] - 5 / 7) < 1e-12
    prec = {0: 1 / 2, 1: 2 / 3, 2: 1.0}
    rec = {0: 1 / 2, 1: 1.0, 2: 2 / 3}
    w = {0: 2 / 7, 1: 2 / 7, 2: 3 / 7}
    assert abs(r["weighted_precision"] - sum(prec[k] * w[k] for k in w)) < 1e-12
    f1 = {k: 2 * prec[k] * rec[k] / (prec[k] + rec[k]) for k in w}
    assert abs(r["weighted_f1"] - sum(f1[k] * w[k] for k in w)) < 1e-12


def test_regression_metrics(spark):
    pdf = pd.DataFrame({"label": [1.0, 2.0, 3.0, 4.0], "prediction": [1.5, 2.0, 2.0, 5.0]})
    r = M.regression_metrics(spark.createDataFrame(pdf)).first()
    e = pdf.prediction - pdf.label
    assert abs(r["mse"] - (e ** 2).mean()) < 1e-12 and abs(r["mae"] - e.abs().mean()) < 1e-12
    assert abs(r["r2"] - (1 - (e ** 2).sum() / ((pdf.label - pdf.label.mean()) ** 2).sum())) < 1e-12

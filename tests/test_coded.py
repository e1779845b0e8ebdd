"""Leaves and sums of coded rows by groups of bundles: the same as row by row; the booster's state is blocks of one fold."""

import numpy as np
import pytest

from proxlab.operators import boost, coded


def _tree(rng, sizes, depth):
    """left, right, bundle, last code to go left, of a tree whose nodes are now and then leaves."""
    left, right, bundle, upto, todo = [-1], [-1], [0], [0], [(0, 0)]
    while todo:
        v, d = todo.pop()
        if d < depth and (d < 2 or rng.random() < 0.9):
            left[v], right[v], bundle[v] = len(left), len(left) + 1, int(rng.integers(len(sizes)))
            upto[v] = int(rng.integers(sizes[bundle[v]]))
            todo += [(left[v], d + 1), (right[v], d + 1)]
            for x, blank in ((left, -1), (right, -1), (bundle, 0), (upto, 0)):
                x += [blank, blank]
    return tuple(map(np.array, (left, right, bundle, upto)))


@pytest.mark.parametrize("depth", [1, 4, 8])
def test_leaves_by_bits_are_those_of_a_walk(depth):
    rng = np.random.default_rng(depth)
    sizes, first = np.array([5, 40, 2, 70]), np.array([0, 5, 45, 47])
    rows = np.stack([rng.integers(0, n, 500) for n in sizes])
    left, right, bundle, upto = _tree(rng, sizes, depth)
    groups = coded.Groups(sizes, 1 << 12, first)
    found = coded.leaf_masks(left, right, bundle, lambda v, b: np.arange(sizes[b]) <= upto[v][:, None])
    leaves = coded.Leaves(*found, groups)
    got = leaves.node.take(leaves.places(groups.numbers(rows + first[:, None])))
    for row, leaf in zip(rows.T, got):
        v = 0
        while left[v] >= 0:
            v = left[v] if row[bundle[v]] <= upto[v] else right[v]
        assert v == leaf
    assert depth < 8 or leaves.words > 1


@pytest.mark.parametrize("most", [1, 100, 1 << 14])
def test_sums_by_groups_are_those_of_every_bundle(most):
    rng = np.random.default_rng(2)
    sizes = np.array([5, 40, 2, 70])
    rows, w = np.stack([rng.integers(0, n, 300) for n in sizes]), rng.random(300)
    groups = coded.Groups(sizes, most)
    assert sorted(b for g in groups.members for b in g) == [0, 1, 2, 3] and (most > 1 or len(groups.members) == 4) and (most < 1 << 14 or len(groups.members) < 3)
    for g, at in enumerate(groups.numbers(rows)):
        total = np.zeros((2, groups.cells[g]))
        coded.add_up(total, at, [w, None])
        for b, sums in groups.by_bundle(g, total):
            assert np.allclose(sums[0], np.bincount(rows[b], w, sizes[b])) and (sums[1] == np.bincount(rows[b], minlength=sizes[b])).all()


def _data(spark, n=900):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(n, 3)).round(1)
    y = (X[:, 0] * X[:, 1] > 0.2) + (X[:, 2] > 0.5)
    return spark.createDataFrame([(x.tolist(), float(a), i % 3 if i % 50 else None) for i, (x, a) in enumerate(zip(X, y))], "features array<double>, label double, fold int").repartition(3)


def test_state_is_blocks_and_the_driver_searches_many_nodes_at_once(spark, monkeypatch):
    """Before, the state was a row per row, and the driver searched node by node."""
    calls = []
    plain = boost.best_splits
    monkeypatch.setattr(boost, "best_splits", lambda sums, *rest: calls.append(len(sums)) or plain(sums, *rest))
    points = [boost.HistBoost(objective="multi:softprob", numRound=2, maxDepth=4, minChildWeight=0.1)]
    _, fit = boost.fit_many(_data(spark), [(points[0], f) for f in (0, 1, 2, None)], "fold")
    blocks = fit.state.collect()
    scores = boost.fold_scores(fit, "multi")
    fit.close()
    # 3 folds and the rows without one
    assert len(blocks) < 100 and sum(len(b[2]) for b in blocks) == 900 and all(b[1].dtype == np.uint8 and b[1].shape[0] == 3 for b in blocks)
    assert len(calls) <= 2 * 4 and max(calls) > 12 and sorted(scores) == [0, 1, 2] and min(scores.values()) > 0.7


@pytest.mark.parametrize("growth", ["depth", "leaf"])
def test_trees_too_large_for_bits_and_small_groups_give_the_same_model(spark, monkeypatch, growth):
    data, tables = _data(spark), []
    for leaves, most, total, block in ((1 << 9, 1 << 12, 1 << 13, 1 << 15), (1, 1, 1, 100), (1 << 9, 1 << 30, 1 << 30, 64)):
        for where, name, v in ((coded, "MOST_LEAVES", leaves), (boost, "GROUP_CODES", most), (coded, "GROUP_SUMS", total), (boost, "BLOCK_ROWS", block)):
            monkeypatch.setattr(where, name, v)
        est = boost.HistBoost(objective="multi:softprob", numRound=3, maxDepth=5, growth=growth, numLeaves=8, minChildWeight=0.1)
        tables.append(est.fit(data.drop("fold")).nodes.to_pandas())
    for t in tables[1:]:
        assert (t.feature == tables[0].feature).all() and np.allclose(t.value, tables[0].value)


def test_categories_are_not_named_in_the_metadata_that_python_reads(spark, monkeypatch, tmp_path):
    """Before, every pass over the one-hot column read a name for each category on the driver."""
    from proxlab.operators import bins
    from proxlab.plans.registry import load_all

    rows = [(i, i % 7, i % 40, 100.0 + i, 900.0 if i % 40 == 3 else float(i % 50), i % 11 / 100, i % 9 / 100) for i in range(400)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, plain = [], bins.find_bins
    monkeypatch.setattr(bins, "find_bins", lambda rows, *a: seen.append(rows.schema["features"].metadata) or plain(rows, *a))
    found = load_all()[0]["boost_sparse_categories"](spark, str(tmp_path)).collect()
    assert len(found) == 1 and (found[0].category, found[0].h_with, found[0].h_without) == (3, 10.0, 390.0)
    assert len(seen) == 1 and "ml_attr" not in seen[0]

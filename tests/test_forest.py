from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.operators import churn, forest

WEIGHTS = np.array([1.0, 1.5])


def binned(n=3000, features=5, seed=1):
    rng = np.random.RandomState(seed)
    x = rng.randint(0, forest.BINS, (n, features)).astype(np.uint8)
    y = (x[:, 0] + x[:, 1] // 2 + rng.randint(0, 20, n) > 32).astype(np.uint8)
    return x, y, rng.poisson(1.0, n).astype(np.uint8)


def rows(spark, n=3000, seed=2):
    rng = np.random.RandomState(seed)
    x = np.round(rng.randn(n, 3) * 100)
    y = (x[:, 0] + x[:, 1] + 50 * rng.randn(n) > 30).astype(int)
    return spark.createDataFrame(
        [(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, b double, c double, churn int").repartition(3)


def all_cuts(x, y, n, least):
    """Gain, feature and bin of the best cut by trying all, most gain first."""
    def impurity(keep):
        c = np.bincount(y[keep], n[keep], 2) * WEIGHTS
        return c.sum(), 1 - ((c / c.sum()) ** 2).sum()

    whole, before = impurity(np.ones(len(y), bool))
    found = []
    for f in range(x.shape[1]):
        for b in range(forest.BINS - 1):
            left = x[:, f] <= b
            if min(n[left].sum(), n[~left].sum()) >= least:
                (p, q), (r, s) = impurity(left), impurity(~left)
                found.append((before - (p * q + r * s) / whole, f, b))
    return sorted(found, key=lambda v: (-v[0], v[1], v[2]))


def test_best_cut_equals_a_search_over_all():
    x, y, n = binned(400)
    tree = forest.grow(x, y, n, WEIGHTS, 1, 5, 5)
    gain, feature, cut = all_cuts(x, y, n, 5)[0]
    assert tree["gain"][0] == pytest.approx(gain) and (tree["feature"][0], tree["bin"][0]) == (feature, cut)


def test_every_node_is_cut_as_far_as_it_may():
    x, y, n = binned(600)
    tree = forest.grow(x, y, n, WEIGHTS, 4, 5, 5)
    at = forest._place(tree, x)
    for node in np.flatnonzero(tree["left"] < 0):
        here = at == node
        counts = np.bincount(y[here], n[here], 2)
        assert tuple(counts) == (tree["n0"][node], tree["n1"][node]) and counts.sum() >= 5
        if tree["depth"][node] < 4 and counts.min():
            left = all_cuts(x[here], y[here], n[here], 5)
            assert not left or left[0][0] < 1e-9


def test_rows_survive_packing():
    x = binned(50, 7)[0]
    assert (forest.unpacked(forest.packed(x), 7) == x).all()


def test_trees_do_not_depend_on_where_nodes_are_grown(spark, monkeypatch):
    df = rows(spark)
    edges = [np.linspace(-200, 200, 31)] * 3
    blocks = forest._blocks(df, ("a", "b", "c"), "churn", edges).rdd

    def trees(local):
        monkeypatch.setattr(forest, "LOCAL", local)
        tops = {t: forest._root(3000) for t in range(3)}
        forest._large_nodes(blocks, tops, WEIGHTS, 7, 5, 3, 3, 9)
        assert (max(len(t["left"]) for t in tops.values()) > 1) == (local < 3000)
        return dict(forest._whole_trees(blocks, tops, WEIGHTS, 7, 5, 3, 3, 9).collect())

    def shape(tree, node=0):
        below = int(tree["left"][node])
        own = (int(tree["n0"][node]), int(tree["n1"][node]))
        return own if below < 0 else (own, int(tree["feature"][node]), shape(tree, below), shape(tree, below + 1))

    whole, parted, high = trees(10**6), trees(400), trees(0)
    assert [shape(whole[t]) for t in range(3)] == [shape(parted[t]) for t in range(3)]
    assert [shape(whole[t]) for t in range(3)] == [shape(high[t]) for t in range(3)]


def test_two_leaves_of_one_prediction_become_one():
    x, y, n = binned(800)
    tree = forest.prune(forest.grow(x, y, n, WEIGHTS, 6, 5, 5), WEIGHTS)
    leaf = tree["left"] < 0
    ones = tree["n1"] * WEIGHTS[1] > tree["n0"] * WEIGHTS[0]
    for left in tree["left"][~leaf]:
        assert not (leaf[left] and leaf[left + 1] and ones[left] == ones[left + 1])
    assert leaf.sum() == (~leaf).sum() + 1 and len(set(tree["left"][~leaf])) == (~leaf).sum()


def test_forest_is_a_spark_model_of_all_its_rows(spark, tmp_path, monkeypatch):
    """Node counts, scores by hand and a copy from disk; in batches of trees, and again the same."""
    from storelens.sources.tables import load_model, save_model

    monkeypatch.setattr(forest, "BATCH_BYTES", 3 * 3000 * 4)
    df = rows(spark).withColumn("customer_unique_id", F.monotonically_increasing_id())
    model = churn.train_rf(df, trees=7, depth=6, features=("a", "b", "c"))
    fitted = model.stages[-1]
    assert fitted.getNumTrees == 7 and max(t.depth for t in fitted.trees) <= 6 and fitted.numClasses == 2
    assert fitted.getOrDefault("maxDepth") == 6 and fitted.getOrDefault("minInstancesPerNode") == 5
    assert abs(fitted.featureImportances.toArray().sum() - 1) < 1e-9
    assert fitted.featureImportances[2] < min(fitted.featureImportances[0], fitted.featureImportances[1])
    scored = churn.predict(model, df)
    right = scored.agg(F.avg((F.col("churn_prediction") == F.col("churn")).cast("int"))).first()[0]
    assert right > 0.85
    save_model(model, f"{tmp_path}/rf")
    kept = churn.predict(load_model(f"{tmp_path}/rf"), df)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, scored.collect()))
    again = churn.train_rf(df, trees=7, depth=6, features=("a", "b", "c")).stages[-1]
    assert again.featureImportances == fitted.featureImportances


def test_rows_of_a_forest_are_read_few_times(spark, monkeypatch):
    """Before, every level of every tree was a pass over the rows with counts for each of its nodes."""
    from storelens.plans import experiments

    def refuse(*_, **__):
        raise AssertionError("levels of small nodes need no pass over all rows")

    monkeypatch.setattr(churn, "RandomForestClassifier", refuse, raising=False)
    df = rows(spark).withColumn("customer_unique_id", F.monotonically_increasing_id().cast("string"))
    trained = experiments.train_models(df, ("a", "b", "c"), trees=4, tree_depth=9)
    assert trained.models["RandomForest"].stages[-1].totalNumNodes > 50


def test_few_rows_one_class_and_gaps(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 1)], "a double, churn int")
    assert churn.train_rf(df, trees=2, depth=3, features=("a",)).stages[-1].totalNumNodes == 2
    one = churn.train_rf(df.where("churn = 1"), trees=2, depth=3, features=("a",))
    assert {r["churn_prediction"] for r in churn.predict(one, df).collect()} == {1}
    with pytest.raises(Exception, match="missing"):
        churn.train_rf(df.withColumn("a", F.lit(None).cast("double")), trees=2, depth=3, features=("a",))


def test_cuts_lie_between_values():
    assert forest.cuts(np.array([1.0, 1, 2, 4])).tolist() == [1.5, 3.0]
    many = forest.cuts(np.arange(10_000.0))
    assert len(many) == forest.BINS - 1 and np.diff(many).max() < 320
    assert len(forest.cuts(np.array([5.0]))) == 0

"""Histogram boosting against a search over all cuts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.operators import boosting

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.RandomState(5)
    x = np.round(rng.randn(500, 3) * 2, 1)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0) ^ (rng.rand(500) < 0.1)).astype(int)
    rows = [(*map(float, v), int(t)) for v, t in zip(x, y)]
    rows += [(None, 1.0, 2.0, 1), (0.0, None, 1.0, 0), (1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "a double, b double, c double, y int")


def brute_tree(x, g, h, edge, depth, step, penalty, least):
    """node -> (feature, cut) or leaf value, by trying every cut of every feature."""
    out = {}

    def grow(node, at, left):
        total, weight = g[at].sum(), h[at].sum()
        best = None
        if left:
            for f, name in enumerate(NAMES):
                for cut in edge[name]:
                    low = at & (x[:, f] <= cut)
                    high = at & ~(x[:, f] <= cut)
                    if h[low].sum() < least or h[high].sum() < least:
                        continue
                    gain = (g[low].sum() ** 2 / (h[low].sum() + penalty) + g[high].sum() ** 2 / (h[high].sum() + penalty)
                            - total ** 2 / (weight + penalty))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, name, cut, low, high)
        if best is None:
            out[node] = -step * total / (weight + penalty)
            return
        out[node] = (best[1], best[2])
        grow(2 * node + 1, best[3], left - 1)
        grow(2 * node + 2, best[4], left - 1)

    grow(0, np.ones(len(g), bool), depth)
    return out


def test_first_tree_is_that_of_a_full_search(table):
    known = table.where("y IS NOT NULL")
    edge = boosting.edges(known, NAMES, 16)
    assert all(len(c) <= 15 and c == sorted(set(c)) for c in edge.values())
    model = boosting.Boosted([], edge, 0.0)
    rows = model.binned(known).select("bins", (0.5 - F.col("y")).alias("g"), F.lit(0.25).alias("h"))
    tree = boosting.grow(rows, edge, 3, 0.1)
    data = [tuple(r) for r in known.collect()]
    x = np.array([[-np.inf if v is None else v for v in r[:3]] for r in data], float)
    y = np.array([r[3] for r in data], float)
    wanted = brute_tree(x, 0.5 - y, np.full(len(y), 0.25), edge, 3, 0.1, boosting.PENALTY, boosting.LEAST_CURVATURE)
    found = {n: c[:2] for n, c in tree.cuts.items()} | tree.leaves
    assert set(found) == set(wanted)
    for node, value in wanted.items():
        assert found[node] == (value if isinstance(value, tuple) else pytest.approx(value))


def test_boosting_lowers_the_loss_and_scores_what_it_learnt(table):
    model = boosting.fit(table, NAMES, "y", rounds=6, depth=3, step=0.5, bins=16, freeze=2)
    assert len(model.trees) == 6
    rows = model.score(table.where("y IS NOT NULL")).collect()
    p = np.array([r["churn_probability"] for r in rows])
    y = np.array([r["y"] for r in rows])
    assert ((p > 0.5) == y).mean() > 0.85
    assert set(rows[0].asDict()) == {"a", "b", "c", "y", "churn_probability"}


def test_nothing_to_learn(table):
    model = boosting.fit(table.where("y > 5"), NAMES, "y", rounds=1, depth=2, bins=4)
    assert {r["churn_probability"] for r in model.score(table).collect()} == {0.5}
    flat = table.withColumns({n: F.lit(1.0) for n in NAMES})
    tree = boosting.fit(flat, NAMES, "y", rounds=1, depth=2, bins=4).trees[0]
    assert not tree.cuts and set(tree.leaves) == {0}


def test_first_tree_as_rows(table):
    rows = {r["node"]: r for r in boosting.first_tree(table, NAMES, "y", depth=1, bins=16).collect()}
    assert set(rows) == {0, 1, 2} and rows[0]["feature"] in NAMES and rows[0]["gain"] > 0 and rows[0]["leaf"] is None
    assert all(rows[n]["feature"] is None and rows[n]["leaf"] is not None for n in (1, 2))
    alone = boosting.first_tree(table.where("y > 5"), NAMES, "y", bins=4).collect()
    assert all(r["feature"] is None for r in alone)

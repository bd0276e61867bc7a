"""Second-order boosted trees on histograms, grown a level at a time.

Features are cut at their quantiles once. For every level of a tree one aggregate over the rows gives the sums of gradient
and curvature for each (node, feature, bin); running sums over the bins of these few rows give the gain of
every cut, and the best cut of each node becomes part of the model. So a level costs one pass with partial sums, and what comes
to the driver is at most one row for each node. Leaves are the penalised Newton step of their rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.quantiles import exact_quantiles
from storelens.session import materialize

BINS, PENALTY, LEAST_CURVATURE = 64, 1.0, 1.0


@dataclass
class Tree:
    """Cuts by node (the children of node n are 2n + 1 and 2n + 2) and the values of its leaves."""

    cuts: dict[int, tuple[str, float, float]] = field(default_factory=dict)  # feature, cut, gain
    leaves: dict[int, float] = field(default_factory=dict)


def edges(df: DataFrame, features: tuple[str, ...], bins: int = BINS) -> dict[str, list[float]]:
    """Distinct quantiles of each feature: at most bins - 1 numbers, whatever the rows."""
    probs = tuple(i / bins for i in range(1, bins))
    rows = exact_quantiles(df, list(features), probs).collect()  # a row for each feature
    found = {r["column"]: sorted({r[f"q{i}"] for i in range(len(probs)) if r[f"q{i}"] is not None}) for r in rows}
    return {f: found.get(f, []) for f in features}


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts lie below the value; a NULL goes with the lowest values."""
    value = F.coalesce(F.col(f"`{feature}`").cast("double"), F.lit(float("-inf")))
    if not cuts:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + F.when(value > c, 1).otherwise(0))


def _walk(tree: Tree, depth: int, bin_of: dict[str, int], edge: dict[str, list[float]]) -> Column:
    """The node of a row at a depth, from its bins; rows stay in a leaf once they are there."""

    def below(node: int, left: int) -> Column:
        if node not in tree.cuts or left == 0:
            return F.lit(node)
        feature, cut, _ = tree.cuts[node]
        goes_left = F.col("bins")[bin_of[feature]] <= edge[feature].index(cut)
        return F.when(goes_left, below(2 * node + 1, left - 1)).otherwise(below(2 * node + 2, left - 1))

    return below(0, depth)


def best_cuts(
    rows: DataFrame, node: Column, edge: dict[str, list[float]], penalty: float = PENALTY,
    least: float = LEAST_CURVATURE,
) -> DataFrame:
    """node, g, h, and feature, bin and gain of the best cut of each node (NULL if none gains).

    rows have bins (an array in the order of `edge`), g and h. The gain is G1²/(H1+penalty) + G2²/(H2+penalty) -
    G²/(H+penalty), over cuts that leave `least` curvature on either side; ties to the first feature and the lowest cut.
    """
    cells = (
        rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    )
    up_to = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")  # at most a row for each bin
    sides = cells.select(
        "node", "feature", "bin", F.sum("g").over(up_to).alias("g1"), F.sum("h").over(up_to).alias("h1"),
        F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"))
    g2, h2 = F.col("g") - F.col("g1"), F.col("h") - F.col("h1")

    def score(g: Column, h: Column) -> Column:
        return g * g / (h + F.lit(penalty))

    gain = score(F.col("g1"), F.col("h1")) + score(g2, h2) - score(F.col("g"), F.col("h"))
    allowed = (F.col("h1") >= least) & (h2 >= least) & (gain > 1e-9)
    cut = F.when(allowed, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return sides.groupBy("node").agg(
        F.max(F.struct((F.col("feature") == 0).alias("first"), "g", "h")).alias("sum"), F.max(cut).alias("cut"),
    ).select(
        "node", "sum.g", "sum.h", (-F.col("cut.f")).alias("feature"), (-F.col("cut.b")).alias("bin"),
        F.col("cut.gain").alias("gain"))


def grow(
    rows: DataFrame, edge: dict[str, list[float]], depth: int, step: float,
    penalty: float = PENALTY, least: float = LEAST_CURVATURE,
) -> Tree:
    """One tree over rows (bins, g, h); every level is one aggregate. Nodes are few: at most 2 to the depth."""
    tree, names = Tree(), list(edge)
    bin_of = {f: i for i, f in enumerate(names)}
    open_nodes = {0}
    for level in range(depth + 1):
        placed = rows.withColumn("at", _walk(tree, level, bin_of, edge))
        if level == depth:  # no cuts any more, so one feature gives the sums
            placed = placed.withColumn("bins", F.slice("bins", 1, 1))
        found = best_cuts(placed, F.col("at"), edge, penalty, least).collect()  # at most a row for each node
        for r in found:
            if r["node"] not in open_nodes:
                continue
            node, feature = r["node"], r["feature"]
            if level < depth and feature is not None and r["bin"] < len(edge[names[feature]]):
                tree.cuts[node] = (names[feature], edge[names[feature]][r["bin"]], r["gain"])
            else:
                tree.leaves[node] = -step * r["g"] / (r["h"] + penalty)
        open_nodes = {c for n in open_nodes & set(tree.cuts) for c in (2 * n + 1, 2 * n + 2)}
        if not open_nodes:
            break
    return tree


def _value(tree: Tree, bin_of: dict[str, int], edge: dict[str, list[float]]) -> Column:
    """What a tree adds to the margin of a row, from its bins."""

    def below(node: int) -> Column:
        if node not in tree.cuts:
            return F.lit(float(tree.leaves.get(node, 0.0)))
        feature, cut, _ = tree.cuts[node]
        goes_left = F.col("bins")[bin_of[feature]] <= edge[feature].index(cut)
        return F.when(goes_left, below(2 * node + 1)).otherwise(below(2 * node + 2))

    return below(0)


@dataclass
class Boosted:
    """Trees with the cuts they were grown on; margins add up from `start`."""

    trees: list[Tree]
    edge: dict[str, list[float]]
    start: float

    def binned(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bins", F.array(*[_bin(f, c) for f, c in self.edge.items()]))

    def score(self, df: DataFrame, name: str = "churn_probability", batch: int = 20) -> DataFrame:
        """df with the probability of label 1; trees are added `batch` at a time, to keep expressions small."""
        bin_of = {f: i for i, f in enumerate(self.edge)}
        out = self.binned(df).withColumn("_margin", F.lit(float(self.start)))
        for i in range(0, len(self.trees), batch):
            total = F.col("_margin")
            for tree in self.trees[i:i + batch]:
                total = total + _value(tree, bin_of, self.edge)
            out = out.withColumn("_margin", total)
        return out.withColumn(name, 1 / (1 + F.exp(-F.col("_margin")))).drop("bins", "_margin")


def fit(
    df: DataFrame, features: tuple[str, ...], label: str, rounds: int = 20, depth: int = 6, step: float = 0.1,
    bins: int = BINS, penalty: float = PENALTY, freeze: int = 10,
) -> Boosted:
    """Boosted trees for a 0/1 label by the logistic loss.

    Rows keep their margin; it is written out every `freeze` trees, so that no plan holds more of them. Rows without a label
    are left out; a missing feature counts as lowest. No rows, or depth 0: the start alone decides.
    """
    known = df.where(F.col(label).isNotNull())
    model = Boosted([], edges(known, features, bins), 0.0)
    bin_of = {f: i for i, f in enumerate(model.edge)}
    rows = materialize(
        model.binned(known).select("bins", F.col(label).cast("double").alias("y"), F.lit(0.0).alias("margin")),
        "boosting-rows")
    for number in range(rounds):
        p = 1 / (1 + F.exp(-F.col("margin")))
        graded = rows.select("bins", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
        tree = grow(graded, model.edge, depth, step, penalty)
        model.trees.append(tree)
        rows = rows.withColumn("margin", F.col("margin") + _value(tree, bin_of, model.edge))
        if number % freeze == freeze - 1 and number + 1 < rounds:
            rows = materialize(rows, "boosting-rows")
    return model


def first_tree(
    df: DataFrame, features: tuple[str, ...], label: str, depth: int = 1, step: float = 0.1, bins: int = BINS
) -> DataFrame:
    """node, feature, cut, gain and leaf of the first tree, grown where every margin is 0.

    A node that is cut has no leaf value, and a leaf has no cut. Rows without a label are left out.
    """
    known = df.where(F.col(label).isNotNull())
    edge = edges(known, features, bins)
    graded = Boosted([], edge, 0.0).binned(known).select(
        "bins", (F.lit(0.5) - F.col(label).cast("double")).alias("g"), F.lit(0.25).alias("h"))
    tree = grow(graded, edge, depth, step)
    rows = [(n, *c, None) for n, c in tree.cuts.items()] + [(n, None, None, None, v) for n, v in tree.leaves.items()]
    return df.sparkSession.createDataFrame(  # at most a row for each node
        sorted(rows), "node long, feature string, cut double, gain double, leaf double")

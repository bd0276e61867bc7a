"""Customer segments by k-means over the quartile scores.

Three scores of one to four leave at most 64 distinct points. Everything that
depends only on the points is computed on these weighted cells, whatever the
number of customers; only the final assignment touches every customer.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.columns import ratio, round_half_even
from storelens.operators.rfm import SCORES
from storelens.session import materialize


def _scored(scores: DataFrame) -> DataFrame:
    return scores.dropna(subset=list(SCORES))


def score_cells(scores: DataFrame) -> DataFrame:
    """The at most 64 distinct score triples with their number of customers, n.

    A customer who lacks a score is in none.
    """
    return _scored(scores).groupBy(*SCORES).agg(F.count(F.lit(1)).alias("n"))


def _z(c: str, stats: DataFrame) -> Column:
    """c in standard units by the one-row stats; a constant column gives 0."""
    std = stats.select(f"{c}_std").scalar()
    return (F.col(c) - stats.select(f"{c}_mean").scalar()) / F.when(std == 0, 1.0).otherwise(std)


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds z_<col> with the population standard deviation; a constant column gives 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
    )
    return df.withColumns({f"z_{c}": _z(c, stats) for c in cols})


def _standard_cells(cells: DataFrame) -> DataFrame:
    """Cells with z columns, each cell counting as the n customers in it."""
    n = F.sum("n").cast("double")
    means = {c: F.sum(F.col(c) * F.col("n")) / n for c in SCORES}
    squares = {c: F.sum(F.col(c) * F.col(c) * F.col("n")) / n for c in SCORES}
    stats = cells.agg(
        *[m.alias(f"{c}_mean") for c, m in means.items()],
        *[F.sqrt(squares[c] - means[c] * means[c]).alias(f"{c}_std") for c in SCORES],
    )
    return cells.withColumns({f"z_{c}": _z(c, stats) for c in SCORES})


def assign_to_centres(scores: DataFrame, centres: list[tuple[float, ...]]) -> DataFrame:
    """Adds cluster: the nearest of the given centres in score space, lowest id on ties.

    Customers who lack a score are left out.
    """
    distances = [
        F.struct(
            sum((F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(SCORES, centre)).alias("d"),
            F.lit(i).alias("cluster"),
        )
        for i, centre in enumerate(centres)
    ]
    return _scored(scores).withColumn("cluster", F.array_min(F.array(*distances))["cluster"])


def _points(scores: DataFrame) -> DataFrame:
    """Standardised cells as vectors: at most 64 rows, written once for the many small fits."""
    z = F.array(*[F.col(f"z_{c}") for c in SCORES])
    cells = _standard_cells(score_cells(scores)).select(
        *SCORES, F.col("n").cast("double").alias("n"), array_to_vector(z).alias("point")
    )
    return materialize(cells.coalesce(1), "score-cells")


def _best_fits(
    points: DataFrame, ks: list[int], n_init: int, seed: int, parallelism: int
) -> dict[int, tuple[float, KMeansModel]]:
    """k -> inertia and model of the best of n_init weighted fits.

    The fits are independent jobs of a few milliseconds each, so several are
    submitted at a time.
    """

    def fit(start: tuple[int, int]) -> tuple[float, KMeansModel]:
        k, i = start
        model = KMeans(
            k=k, seed=seed + i, maxIter=300, tol=1e-4, featuresCol="point", weightCol="n"
        ).fit(points)
        return model.summary.trainingCost, model

    starts = [(k, i) for k in ks for i in range(n_init)]
    with ThreadPoolExecutor(parallelism) as pool:
        fits = list(pool.map(inheritable_thread_target(points.sparkSession)(fit), starts))
    best: dict[int, tuple[float, KMeansModel]] = {}
    for (k, _), found in zip(starts, fits):
        if k not in best or found[0] < best[k][0]:
            best[k] = found
    return best


def _labels(model: KMeansModel, points: DataFrame) -> DataFrame:
    """Cells with cluster, numbered by centre so that equal fits get equal numbers."""
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    number = F.create_map(*[F.lit(x) for new, old in enumerate(order) for x in (old, new)])
    return model.transform(points).select(
        *SCORES, F.col("n").cast("bigint").alias("n"), number[F.col("prediction")].alias("cluster")
    )


def kmeans_segments(
    scores: DataFrame, k: int = 5, n_init: int = 10, seed: int = 42, parallelism: int = 8
) -> DataFrame:
    """Adds cluster from the best of n_init k-means fits."""
    points = _points(scores)
    _, model = _best_fits(points, [k], n_init, seed, parallelism)[k]
    cells = F.broadcast(_labels(model, points).drop("n"))  # at most 64 rows
    return scores.join(cells, list(SCORES))


def elbow(
    scores: DataFrame,
    ks: range = range(2, 11),
    n_init: int = 10,
    seed: int = 42,
    parallelism: int = 8,
) -> DataFrame:
    """k, inertia of the best fit."""
    fits = _best_fits(_points(scores), list(ks), n_init, seed, parallelism)
    rows = [(k, float(cost)) for k, (cost, _) in fits.items()]
    return scores.sparkSession.createDataFrame(rows, "k int, inertia double").orderBy("k")


def _silhouettes(cells: DataFrame) -> DataFrame:
    """k, silhouette from cells (k, scores, z columns, n, cluster), per k.

    Customers in one cell share their distances, so each cell looks at the list
    of the cells of its k (at most 64 per cluster) instead of at other customers.
    """
    cells = cells.select("k", "cluster", "n", F.array(*[F.col(f"z_{c}") for c in SCORES]).alias("z"))
    lists = cells.groupBy("k").agg(
        F.sort_array(F.collect_list(F.struct("cluster", "z", "n"))).alias("cells")
    )

    def total(kept: Column) -> tuple[Column, Column]:
        """Customers in the kept cells, and the sum of distances to them."""

        def distance(other: Column) -> Column:
            gaps = [F.col("z")[i] - other["z"][i] for i in range(len(SCORES))]
            return F.sqrt(sum(gap * gap for gap in gaps))

        return (
            F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, o: acc + o["n"]),
            F.aggregate(kept, F.lit(0.0), lambda acc, o: acc + o["n"] * distance(o)),
        )

    def of_cluster(c: Column) -> Column:
        return F.filter("cells", lambda o: o["cluster"] == c)

    def mean_distance(c: Column) -> Column:
        size, away = total(of_cluster(c))
        return away / size

    rivals = F.filter(
        F.array_distinct(F.transform("cells", lambda o: o["cluster"])),
        lambda c: c != F.col("cluster"),
    )
    size, away = total(of_cluster(F.col("cluster")))
    sides = cells.join(lists, "k").select(
        "k",
        "n",
        size.alias("size"),
        F.try_divide(away, size - 1).alias("a"),  # a customer is no neighbour of itself
        F.array_min(F.transform(rivals, mean_distance)).alias("b"),
    )
    gap = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    score = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(gap, F.lit(0.0)))
    return sides.groupBy("k").agg(ratio(F.sum(F.col("n") * score), F.sum("n")).alias("silhouette"))


def silhouette(clustered: DataFrame) -> DataFrame:
    """Exact mean silhouette, Euclidean on standardised scores, over all customers."""
    cells = clustered.groupBy(*SCORES, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return _silhouettes(_standard_cells(cells).withColumn("k", F.lit(0))).select("silhouette")


def silhouette_by_k(
    scores: DataFrame,
    ks: range = range(2, 11),
    n_init: int = 10,
    seed: int = 42,
    parallelism: int = 8,
) -> DataFrame:
    """k, inertia and exact silhouette of the best fit for each k."""
    points = _points(scores)
    fits = _best_fits(points, list(ks), n_init, seed, parallelism)
    labelled = reduce(
        DataFrame.unionByName,
        [_labels(model, points).withColumn("k", F.lit(k)) for k, (_, model) in fits.items()],
    )
    cells = _standard_cells(score_cells(scores)).drop("n").join(labelled, list(SCORES))
    costs = F.create_map(*[F.lit(x) for k, (cost, _) in fits.items() for x in (k, float(cost))])
    return (
        _silhouettes(cells)
        .select("k", costs[F.col("k")].alias("inertia"), "silhouette")
        .orderBy("k")
    )


def best_k(by_k: DataFrame, measure: str = "silhouette") -> DataFrame:
    """The k with the highest measure; the smallest k on ties."""
    return by_k.agg(F.max_by("k", F.struct(F.col(measure), -F.col("k"))).alias("best_k"))


def segment_profile(clustered: DataFrame) -> DataFrame:
    """One row per cluster: size, means at two digits, share, and a business label.

    The label compares the cluster with the medians over the clusters; a label
    that occurs again gets a number in cluster order.
    """
    measures = ("recency", "frequency", "monetary", *SCORES)
    sums = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_customers"), *[F.sum(c).alias(c) for c in measures]
    )
    means = sums.select(
        "cluster",
        "n_customers",
        *[round_half_even(ratio(c, "n_customers")).alias(c) for c in measures],
    )
    middle = means.agg(
        F.percentile("recency", F.lit(0.5)).alias("r"),
        F.percentile("monetary", F.lit(0.5)).alias("m"),
        F.sum("n_customers").alias("n"),
    )
    r_mid, m_mid, total = (middle.select(c).scalar() for c in ("r", "m", "n"))
    recent, rich = F.col("recency") <= r_mid, F.col("monetary") >= m_mid
    label = (
        F.when((F.col("monetary") >= m_mid * 1.3) & (F.col("frequency") >= 1.05), "VIP")
        .when(recent & rich, "Loyal")
        .when(recent, "New")
        .when(rich, "At Risk")
        .otherwise("Lost")
    )
    nth = F.row_number().over(Window.partitionBy("label").orderBy("cluster"))
    return (
        means.withColumn(
            "pct",
            round_half_even(100.0 * F.col("n_customers").cast("double") / total.cast("double")),
        )
        .withColumn("label", label)
        .withColumn("_nth", nth)
        .withColumn(
            "label",
            F.when(F.col("_nth") == 1, F.col("label")).otherwise(
                F.concat_ws("_", "label", F.col("_nth").cast("string"))
            ),
        )
        .drop("_nth")
        .orderBy("cluster")
    )


def segment_table(clustered: DataFrame, profile: DataFrame) -> DataFrame:
    """Every customer with cluster and segment; the profile has one row per cluster."""
    labels = profile.select("cluster", F.col("label").alias("segment"))
    return clustered.join(F.broadcast(labels), "cluster", "left").select(
        *clustered.columns, "segment"
    )


def segment_distribution(segments: DataFrame) -> DataFrame:
    """Customers per segment and their share."""
    total = segments.agg(F.count(F.lit(1))).scalar().cast("double")
    return (
        segments.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "segment",
            "n",
            round_half_even(100.0 * F.col("n").cast("double") / total).alias("pct"),
        )
        .orderBy(F.desc("n"), "segment")
    )

"""What must hold of fitted models whatever their random draws, as rows that SQL can state too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators import churn
from storelens.operators.rfm import SCORES
from storelens.plans.experiments import TEST_SHARE, Trained


def churn_scores(scored: DataFrame) -> DataFrame:
    """Every scored customer: what is known exactly, and whether probability and prediction fit."""
    p = F.col("churn_probability")
    return scored.select(
        "customer_unique_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("recency", "frequency", "lifetime_days", "churn")],
        F.col("monetary").cast("double").alias("monetary"),
        p.between(0, 1).alias("probability_in_range"),
        (F.col("churn_prediction") == (p > 0.5).cast("int")).alias("prediction_fits"),
    )


def tested_models(trained: Trained) -> DataFrame:
    """Per model the test rows, the positives, and whether the confusion cells are consistent."""
    cell = {(a, b): F.count_if((F.col("label") == a) & (F.col("prediction") == b))
            for a in (0, 1) for b in (0, 1)}
    trained.fit_all()
    return reduce(DataFrame.unionByName, [
        rows.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_test"),
            F.sum("label").cast("bigint").alias("n_positive"),
            (sum(cell.values()) == F.count(F.lit(1))).alias("cells_add_up"),
        )
        for name, rows in trained.tested.items()
    ])


def comparison_is_sound(comparison: DataFrame) -> DataFrame:
    """Names, whether exactly one is best and has the highest AUC, and whether all AUCs beat a coin."""
    return comparison.agg(
        F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"),
        F.count_if("is_best").alias("n_best"),
        (F.max(F.when(F.col("is_best"), F.col("roc_auc"))) == F.max("roc_auc")).alias("best_is_highest"),
        (F.min("roc_auc") > 0.5).alias("all_above_half"),
    )


def importance_is_sound(importance: DataFrame) -> DataFrame:
    """Each feature, whether its importance is not negative, and whether all add up to 1."""
    total = importance.agg(F.sum("importance")).scalar()
    return importance.select(
        "feature", (F.col("importance") >= 0).alias("not_negative"),
        (F.abs(total - 1) < 1e-6).alias("sums_to_one"))


def clusters_are_nearest(clustered: DataFrame, fixed: DataFrame) -> DataFrame:
    """Customers, clusters, whether each is nearest to the mean of its own cluster, and whether the
    squared distances add up to no more than those of the `fixed` clusters."""

    def cells(df: DataFrame) -> DataFrame:
        stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in SCORES],
                       *[F.stddev_pop(c).alias(f"s_{c}") for c in SCORES])
        grouped = df.groupBy(*SCORES, "cluster").agg(F.count(F.lit(1)).alias("n"))  # at most 64
        z = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(
            F.col(f"s_{c}"))).alias(f"z_{c}") for c in SCORES]
        return grouped.join(F.broadcast(stats), how="cross").select("cluster", "n", *z)

    def inertia(df: DataFrame):
        own = cells(df)
        means = own.groupBy("cluster").agg(*[
            (F.sum(F.col(f"z_{c}") * F.col("n")) / F.sum("n")).alias(f"c_{c}") for c in SCORES])
        every = F.broadcast(means.agg(F.collect_list(F.struct("*")).alias("means")))
        placed = own.join(every, how="cross")

        def gap(centre):
            return sum((F.col(f"z_{c}") - centre[f"c_{c}"]) ** 2 for c in SCORES)

        mine = F.filter("means", lambda m: m["cluster"] == F.col("cluster"))[0]
        best = F.array_min(F.transform("means", gap))
        return placed.agg(
            F.sum(F.col("n") * gap(mine)).alias("inertia"),
            F.max(gap(mine) - best).alias("excess"),
            F.sum("n").alias("n"), F.countDistinct("cluster").alias("k"))

    found, other = inertia(clustered), inertia(fixed).select("inertia").scalar()
    return found.select(
        F.col("n").cast("bigint").alias("n_customers"), F.col("k").alias("n_clusters"),
        (F.col("excess") < 1e-9).alias("all_nearest"),
        (F.col("inertia") <= other + 1e-6).alias("not_above_fixed"))


def curve_is_sound(by_k: DataFrame, elbow: DataFrame, best: DataFrame) -> DataFrame:
    """Each k, whether inertia falls or stays from the k before, whether the elbow agrees, whether the
    silhouette lies in its range, and whether k is marked best exactly where it is highest."""
    before = by_k.select((F.col("k") + 1).alias("k"), F.col("inertia").alias("_before"))
    bend = elbow.select("k", F.col("inertia").alias("_elbow"))
    top = by_k.agg(F.max("silhouette")).scalar()
    chosen = best.select("best_k").scalar()
    return by_k.join(before, "k", "left").join(bend, "k", "left").select(
        "k",
        F.coalesce(F.col("inertia") <= F.col("_before") + 1e-6, F.lit(True)).alias("not_rising"),
        (F.abs(F.col("inertia") - F.col("_elbow")) < 1e-6).alias("agrees_with_elbow"),
        F.col("silhouette").between(-1, 1).alias("in_range"),
        ((F.col("k") != chosen) | (F.col("silhouette") == top)).alias("best_is_highest"),
    )


def runs_are_sound(runs: DataFrame) -> DataFrame:
    """Each run with its parameter and metric names, and whether all metrics lie in 0..1."""
    return runs.select(
        "run_name",
        F.array_join(F.array_sort(F.map_keys("params")), ",").alias("params"),
        F.array_join(F.array_sort(F.map_keys("metrics")), ",").alias("metrics"),
        F.forall(F.map_values("metrics"), lambda v: v.between(0, 1)).alias("in_range"),
    )


def preview_is_sound(preview: DataFrame, table: DataFrame, key: list[str], n: int) -> DataFrame:
    """Rows of the preview, and whether all of them are rows of the table."""
    unknown = preview.join(table.select(*key), key, "left_anti").agg(F.count(F.lit(1))).scalar()
    return preview.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("all_known", unknown == 0)


def lr_is_optimal(trained: Trained, labelled: DataFrame) -> DataFrame:
    """Training rows, positives, coefficients, and whether the penalised gradient vanishes at them."""
    split = churn.stratified_split(labelled, test=TEST_SHARE)
    train = split.where(~F.col("is_test"))
    slope = churn.lr_gradient(trained.models["LogisticRegression"], train, trained.features)
    return train.agg(
        F.count(F.lit(1)).alias("n_train"), F.sum("churn").cast("bigint").alias("n_positive"),
        F.lit(len(slope) - 1).alias("n_coefficients"),
        F.lit(sum(g * g for g in slope) ** 0.5 < 1e-6).alias("gradient_is_zero"))

"""Exact evaluation of a binary score; nothing is down-sampled or binned.

A scored table has the columns label (0/1), score and prediction (0/1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import ratio, round_half_even
from storelens.functions.ranking import running_totals


def scored(df: DataFrame, label: str, score: str, prediction: str) -> DataFrame:
    """The three columns the functions below read."""
    return df.select(
        F.col(label).cast("int").alias("label"),
        F.col(score).cast("double").alias("score"),
        F.col(prediction).cast("int").alias("prediction"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    """label, prediction, n for all four cells."""
    cells = [(label, prediction) for label in (0, 1) for prediction in (0, 1)]
    counts = scored.agg(*[
        F.count_if((F.col("label") == a) & (F.col("prediction") == b)).alias(f"n{a}{b}")
        for a, b in cells
    ])
    return counts.select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(a).alias("label"),
                    F.lit(b).alias("prediction"),
                    F.col(f"n{a}{b}").alias("n"),
                )
                for a, b in cells
            ])
        )
    )


def classification_metrics(scored: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1; a ratio over nothing is 0."""
    hit = F.col("label") == F.col("prediction")
    counts = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("right"),
        F.count_if(hit & (F.col("label") == 1)).alias("tp"),
        F.sum("label").alias("positive"),
        F.sum("prediction").alias("predicted"),
    )

    def or_zero(num: Column | str, den: Column | str) -> Column:
        return F.coalesce(ratio(num, den), F.lit(0.0))

    return counts.select(
        or_zero("right", "n").alias("accuracy"),
        or_zero("tp", "predicted").alias("precision"),
        or_zero("tp", "positive").alias("recall"),
        or_zero(2 * F.col("tp"), F.col("positive") + F.col("predicted")).alias("f1"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    below = running_totals(_by_score(scored), ["score"], {"neg_upto": "neg"}, "auc")
    # twice the pairs that a score wins, as a wide integer
    wins = F.col("pos").cast("decimal(19,0)") * (2 * F.col("neg_upto") - F.col("neg")).cast(
        "decimal(19,0)"
    )
    sums = below.agg(F.sum(wins).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = 2 * F.col("p").cast("double") * F.col("n").cast("double")
    return sums.select(ratio("wins", pairs).alias("roc_auc"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """threshold, fpr, tpr for every distinct score from the top, after the origin."""
    above = running_totals(
        _by_score(scored), [F.desc("score")], {"pos_upto": "pos", "neg_upto": "neg"}, "roc"
    )
    totals = scored.agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
    )
    points = above.select(
        F.col("score").alias("threshold"),
        ratio("neg_upto", totals.select("n").scalar()).alias("fpr"),
        ratio("pos_upto", totals.select("p").scalar()).alias("tpr"),
    )
    origin = totals.select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points).orderBy(F.desc("threshold"))


def all_metrics(scored: DataFrame) -> DataFrame:
    """One row with the four metrics and roc_auc."""
    return classification_metrics(scored).withColumn("roc_auc", roc_auc(scored).scalar())


def model_comparison(scored_by_name: dict[str, DataFrame]) -> DataFrame:
    """Metrics per model at four digits; is_best marks the first of the highest roc_auc."""
    measures = ("accuracy", "precision", "recall", "f1", "roc_auc")
    rows = reduce(
        DataFrame.unionByName,
        [
            all_metrics(df).select(
                F.lit(i).alias("position"),
                F.lit(name).alias("model"),
                *[round_half_even(m, 4).alias(m) for m in measures],
            )
            for i, (name, df) in enumerate(scored_by_name.items())
        ],
    )
    best = rows.agg(F.max_by("model", F.struct("roc_auc", -F.col("position")))).scalar()
    return rows.withColumn("is_best", F.col("model") == best).orderBy("position").drop("position")

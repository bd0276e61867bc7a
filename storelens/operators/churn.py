"""Customer features, the churn label, and models that predict it."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.columns import (
    hash_number,
    ratio,
    round_half_up,
    share_pct,
    whole_days_between,
)
from storelens.functions.quantiles import exact_quantiles
from storelens.functions.ranking import global_rank
from storelens.functions.skew import left_join
from storelens.operators import forest, logistic
from storelens.operators.rfm import snapshot
from storelens.session import materialize

CHURN_DAYS = 180
UNKNOWN_PARTS = 64

# The model features, in order.
FEATURES = (
    "frequency",
    "monetary",
    "avg_order_value",
    "total_freight",
    "n_items",
    "n_products",
    "n_categories",
    "n_sellers",
    "n_payment_methods",
    "avg_installments",
    "lifetime_days",
    "purchase_frequency",
    "monetary_per_order",
    "avg_review_score",
    "n_reviews",
)
# The features of the tracked variant, in order.
TRACKED_FEATURES = (
    "frequency",
    "monetary",
    "R_score",
    "F_score",
    "M_score",
    "avg_order_value",
    "monetary_per_order",
)


def _reviews_per_order(reviews: DataFrame) -> DataFrame:
    """Sum and number of the scores of each order, so an order with many reviews is one row."""
    return (
        reviews.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.sum("review_score").alias("_sum"), F.count("review_score").alias("_n"))
    )


def _review_columns() -> list[Column]:
    """Aggregates over the distinct orders of a customer, joined with `_reviews_per_order`."""
    return [
        ratio(F.sum("_sum"), F.sum("_n")).alias("avg_review_score"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_reviews"),
    ]


# Where the distinct things of an order come from.
_VARIETY = {
    "products": "product_id", "categories": "product_category_name_english", "sellers": "seller_id"
}


def customer_reviews(fact: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mean score and number of reviews over the distinct orders of each customer.

    Reviews are summed per order before the join, so an order with many reviews
    is one row.
    """
    pairs = (
        fact.where(F.col("customer_unique_id").isNotNull())
        .select("order_id", "customer_unique_id")
        .distinct()
    )
    return (
        pairs.join(_reviews_per_order(reviews), "order_id", "left")
        .groupBy("customer_unique_id")
        .agg(*_review_columns())
    )


def order_side(fact: DataFrame) -> DataFrame:
    """Per customer and order everything that adds up, and the distinct products, categories and sellers.

    One payment type per order is the fact's own rule. Of an unknown customer only the dates are kept.
    """
    known = F.col("customer_unique_id").isNotNull()
    return fact.groupBy("customer_unique_id", "order_id").agg(
        F.min("order_purchase_timestamp").alias("first"),
        F.max("order_purchase_timestamp").alias("last"),
        F.sum("total_amount").alias("amount"),
        F.count("total_amount").alias("amounts"),
        F.sum("freight_value").alias("freight"),
        F.count("order_item_id").alias("items"),
        F.max("payment_type").alias("payment_type"),
        F.sum("payment_installments").alias("installments"),
        F.count("payment_installments").alias("installment_rows"),
        *[F.collect_set(F.when(known, F.col(c))).alias(n) for n, c in _VARIETY.items()],
    )


def _customer_side(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """The rows of `order_side` and the reviews of their orders, added up by customer.

    An order moves once, with its few distinct products in it, instead of each item once for each distinct count.
    Orders of unknown customers end in UNKNOWN_PARTS rows, so that they do not meet in one task.
    """
    unknown = F.col("customer_unique_id").isNull()
    return (
        orders.join(_reviews_per_order(reviews), "order_id", "left")
        .withColumn("_spread", F.when(unknown, F.pmod(F.xxhash64("order_id"), F.lit(UNKNOWN_PARTS))))
        .repartition("customer_unique_id", "_spread")  # whole: lists that tasks began would be larger and no fewer
        .groupBy("customer_unique_id", "_spread")
        .agg(
            F.min("first").alias("first_purchase"),
            F.max("last").alias("last_purchase"),
            F.count("order_id").alias("frequency"),
            F.coalesce(F.sum("amount"), F.lit(0)).alias("monetary"),
            ratio(F.sum("amount"), F.sum("amounts")).alias("avg_order_value"),
            F.coalesce(F.sum("freight"), F.lit(0)).alias("total_freight"),
            F.sum("items").alias("n_items"),
            F.size(F.collect_set("payment_type")).cast("bigint").alias("n_payment_methods"),
            ratio(F.sum("installments"), F.sum("installment_rows")).alias("avg_installments"),
            *[
                F.size(F.array_distinct(F.flatten(F.collect_list(n)))).cast("bigint").alias(f"n_{n}")
                for n in _VARIETY
            ],
            *_review_columns(),
        )
        .drop("_spread")
    )


def churn_features(fact: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per customer: recency, first and last purchase and the fifteen features.

    A customer without reviews gets the median of the customers' mean scores.
    """
    return features_of_orders(order_side(fact), reviews)


def features_of_orders(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """churn_features from the rows of `order_side`, which need no fact table.

    The totals are written, unknown customers among them: the last purchase of all is read off them.
    """
    totals = materialize(_customer_side(orders, reviews), "customer-sides")
    last = totals.select(F.col("last_purchase").alias("order_purchase_timestamp"))
    base = (
        totals.where(F.col("customer_unique_id").isNotNull())
        .withColumn("recency", whole_days_between(snapshot(last), "last_purchase"))
        .withColumn("lifetime_days", whole_days_between("last_purchase", "first_purchase"))
        .withColumn("purchase_frequency", ratio("frequency", F.col("lifetime_days") + 1))
        .withColumn("monetary_per_order", ratio("monetary", "frequency"))
        .withColumn("monetary", F.col("monetary").cast("double"))
        .withColumn("total_freight", F.col("total_freight").cast("double"))
        .select("customer_unique_id", "recency", "first_purchase", "last_purchase", *FEATURES)
    )
    middle = exact_quantiles(base, ["avg_review_score"], (0.5,)).select("q0").scalar()
    return base.withColumn("avg_review_score", F.coalesce("avg_review_score", middle))


def label_churn(df: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """Adds churn: 1 when the last purchase is more than `days` days old."""
    return df.withColumn("churn", F.when(F.col("recency") > days, 1).otherwise(0))


def churn_rate(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("churn").alias("churned"),
        share_pct(F.sum("churn"), F.count("churn")).alias("churn_rate"),
    )


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinite and missing values replaced by the column median; columns become doubles.

    One pass finds the columns that miss anything, and only those are sorted.
    """

    def finite(c: str):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    clean = df.withColumns({c: finite(c) for c in cols})
    gaps = clean.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    incomplete = [c for c in cols if gaps[c]]
    if not incomplete:
        return clean
    medians = exact_quantiles(clean, incomplete, (0.5,)).collect()  # one row per column
    fills = {row["column"]: row["q0"] for row in medians if row["q0"] is not None}
    return clean.fillna(fills) if fills else clean


def stratified_split(
    df: DataFrame,
    label: str = "churn",
    id: str = "customer_unique_id",
    test: float = 0.2,
    seed: int = 42,
    exact: bool = False,
) -> DataFrame:
    """Adds is_test, true for the share `test` of each class.

    The draw is a hash of the id, so it does not depend on partitions or order.
    By default the share holds in expectation; `exact` ranks the draws per class.
    """
    draw = hash_number(id, F.lit(seed))
    if not exact:
        return df.withColumn("is_test", draw < F.lit(int(test * 2**32)))
    ranked = global_rank(df.withColumn("_draw", draw), [label, "_draw", id], "_rank", "split")
    classes = ranked.groupBy(label).agg(
        F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    return left_join(ranked, classes, label).select(
        *df.columns,
        (F.col("_rank") - F.col("_first") < F.round(F.col("_size") * test)).alias("is_test"),
    )


def class_weights(df: DataFrame, label: str = "churn") -> DataFrame:
    """Adds weight = rows / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    whole = sizes.agg(F.sum("_size")).scalar().cast("double")
    kinds = sizes.agg(F.count(F.lit(1))).scalar()
    weights = sizes.select(label, (whole / (kinds * F.col("_size"))).alias("weight"))
    return left_join(df, weights, label)


def _assemble(features: tuple[str, ...], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out)


def train_lr(
    train: DataFrame, features: tuple[str, ...] = FEATURES, max_iter: int = 1000
) -> PipelineModel:
    """Balanced logistic regression on standardised features.

    The penalty is 1 on the sum of the losses. Newton's method takes it to a gradient of zero (`lr_gradient`).
    """
    scaling, rows, x = logistic.scaled(class_weights(train), features, F.col("churn"), F.col("weight"))
    fit = logistic.newton(rows, x, F.col("churn"), F.col("weight"), max_iter=max_iter)
    return logistic.as_model(scaling, fit, "churn")


def lr_gradient(
    model: PipelineModel, train: DataFrame, features: tuple[str, ...] = FEATURES
) -> list[float]:
    """The gradient of the penalised loss of the training rows at the model's coefficients, the intercept last."""
    scaled = model.stages[1].transform(model.stages[0].transform(class_weights(train)))
    values = vector_to_array("features")
    fitted = model.stages[-1]
    beta = np.r_[fitted.coefficients.toArray(), fitted.intercept]
    x = [values[i] for i in range(len(features))]
    return logistic.gradient(scaled, x, F.col("churn"), F.col("weight"), beta).tolist()


def train_rf(
    train: DataFrame,
    trees: int = 200,
    depth: int = 15,
    features: tuple[str, ...] = FEATURES,
    seed: int = 42,
) -> PipelineModel:
    """Balanced random forest."""
    weights = dict(class_weights(train).groupBy("churn").agg(F.max("weight")).collect())  # a row for each class
    return forest.fit(
        train, features, "churn", (weights.get(0, 0.0), weights.get(1, 0.0)), trees, depth, least=5, seed=seed)


def train_gbt(
    train: DataFrame,
    iters: int = 200,
    depth: int = 6,
    step: float = 0.1,
    features: tuple[str, ...] = FEATURES,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees, unweighted."""
    boosted = GBTClassifier(
        labelCol="churn", maxIter=iters, maxDepth=depth, stepSize=step, seed=seed
    )
    return Pipeline(stages=[_assemble(features, "features"), boosted]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds churn_probability and churn_prediction (probability above one half)."""
    scored = model.transform(df)
    return scored.select(
        *df.columns, vector_to_array("probability")[1].alias("churn_probability")
    ).withColumn("churn_prediction", (F.col("churn_probability") > 0.5).cast("int"))


def score_customers(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The churn table for all customers, whether trained on or not."""
    return predict(model, features).select(
        "customer_unique_id",
        "recency",
        "frequency",
        "monetary",
        "lifetime_days",
        "churn",
        "churn_probability",
        "churn_prediction",
    )


def feature_importance(
    model: PipelineModel, features: tuple[str, ...] = FEATURES, n: int | None = None
) -> DataFrame:
    """feature, importance, most important first; one row per feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, values), key=lambda r: (-r[1], r[0]))[:n]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def tracked_features(segments: DataFrame) -> DataFrame:
    """The features of the tracked variant with their label.

    R_score is cut from recency, which also defines the label, so these models
    know more than they should; that is how the variant is defined.
    """
    money = F.col("monetary")
    orders = F.col("frequency")
    return label_churn(
        segments.select(
            "customer_unique_id",
            "recency",
            "frequency",
            money.cast("double").alias("monetary"),
            "R_score",
            "F_score",
            "M_score",
            F.when(money > 0, round_half_up(ratio(money, orders + 1)))
            .otherwise(0.0)
            .alias("avg_order_value"),
            F.when(orders > 0, round_half_up(ratio(money, orders)))
            .otherwise(0.0)
            .alias("monetary_per_order"),
        )
    )

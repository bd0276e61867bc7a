"""Business questions over the fact table, the payments, the reviews and the orders.

Every ranking that is cut to n rows ends its order with the group key, so the
same rows come back each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import (
    SECONDS_PER_DAY,
    city_label,
    money_sum,
    ratio,
    round_half_up,
    seconds_between,
    share_pct,
    whole_days_between,
)


def _category() -> Column:
    return F.col("product_category_name_english").alias("category")


def _orders() -> Column:
    return F.countDistinct("order_id").alias("orders")


def total_revenue(fact: DataFrame) -> DataFrame:
    return fact.agg(money_sum("total_amount").alias("total_revenue"))


def total_orders(fact: DataFrame) -> DataFrame:
    return fact.agg(F.countDistinct("order_id").alias("total_orders"))


def total_customers(fact: DataFrame) -> DataFrame:
    return fact.agg(F.countDistinct("customer_unique_id").alias("total_customers"))


def avg_order_value(fact: DataFrame) -> DataFrame:
    """Revenue per distinct order."""
    sums = fact.agg(F.sum("total_amount").alias("amount"), _orders())
    return sums.select(round_half_up(ratio("amount", "orders")).alias("avg_order_value"))


def kpis(fact: DataFrame) -> DataFrame:
    """Revenue, orders, customers and average order value in one pass.

    Items are summed by order and customer first, so the distinct counts run over those.
    """
    pairs = fact.groupBy("order_id", "customer_unique_id").agg(F.sum("total_amount").alias("amount"))
    sums = pairs.agg(
        F.sum("amount").alias("amount"),
        F.countDistinct("order_id").alias("total_orders"),
        F.countDistinct("customer_unique_id").alias("total_customers"),
    )
    return sums.select(
        F.round("amount", 2).cast("double").alias("total_revenue"),
        "total_orders",
        "total_customers",
        round_half_up(ratio("amount", "total_orders")).alias("avg_order_value"),
    )


def monthly_sales(fact: DataFrame, since: str | None = None) -> DataFrame:
    """Orders and revenue per month, optionally from month `since` (yyyy-MM) on."""
    if since is not None:
        fact = fact.where(F.col("year_month") >= since)
    return (
        fact.groupBy("year_month")
        .agg(_orders(), money_sum("total_amount").alias("revenue"))
        .orderBy("year_month")
    )


def top_products(fact: DataFrame, n: int = 10) -> DataFrame:
    return (
        fact.groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("times_sold"),
            F.countDistinct("order_id").alias("unique_orders"),
            money_sum("total_amount").alias("revenue"),
        )
        .orderBy(F.desc("times_sold"), "product_id")
        .limit(n)
    )


def top_categories(fact: DataFrame, n: int = 10) -> DataFrame:
    return (
        fact.groupBy(_category())
        .agg(_orders(), money_sum("total_amount").alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
        .limit(n)
    )


def top_cities(fact: DataFrame, n: int = 10) -> DataFrame:
    return (
        fact.groupBy("customer_city", "customer_state")
        .agg(_orders(), money_sum("total_amount").alias("revenue"))
        .orderBy(F.desc("revenue"), "customer_city", "customer_state")
        .limit(n)
    )


def top_cities_label(fact: DataFrame, n: int = 10) -> DataFrame:
    """top_cities with `city (ST)` as one column."""
    return top_cities(fact, n).select(city_label().alias("city"), "orders", "revenue")


def top_city_one(fact: DataFrame) -> DataFrame:
    """The city with the highest revenue, whatever the state."""
    return (
        fact.groupBy("customer_city")
        .agg(money_sum("total_amount").alias("revenue"))
        .orderBy(F.desc("revenue"), "customer_city")
        .limit(1)
    )


def top_customers(fact: DataFrame, n: int = 10) -> DataFrame:
    """Customers by spend; somebody known in two cities counts as two."""
    return (
        fact.groupBy("customer_unique_id", "customer_city", "customer_state")
        .agg(_orders(), money_sum("total_amount").alias("total_spent"))
        .orderBy(F.desc("total_spent"), "customer_unique_id", "customer_city", "customer_state")
        .limit(n)
    )


def rfm_sql(fact: DataFrame, n: int | None = 20) -> DataFrame:
    """Recency, frequency, monetary; recency runs from midnight after the last purchase."""
    bought = F.col("order_purchase_timestamp")
    midnight = fact.agg(F.date_add(F.to_date(F.max(bought)), 1).cast("timestamp_ntz")).scalar()
    out = (
        fact.groupBy("customer_unique_id")
        .agg(
            F.max(bought).alias("_last"),
            F.countDistinct("order_id").alias("frequency"),
            money_sum("total_amount").alias("monetary"),
        )
        .select(
            "customer_unique_id",
            whole_days_between(midnight, "_last").alias("recency_days"),
            "frequency",
            "monetary",
        )
    )
    if n is None:
        return out
    return out.orderBy(F.desc("monetary"), "customer_unique_id").limit(n)


def payment_mix(payments: DataFrame) -> DataFrame:
    return (
        payments.groupBy("payment_type")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            money_sum("payment_value").alias("total_value"),
        )
        .orderBy(F.desc("total_value"), "payment_type")
    )


def installments(payments: DataFrame) -> DataFrame:
    return (
        payments.groupBy("payment_installments")
        .agg(F.count(F.lit(1)).alias("transactions"))
        .orderBy("payment_installments")
    )


def _distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows per value and their share; the total is its own column-free scan."""
    whole = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.groupBy(col)
        .agg(F.count(F.lit(1)).alias("total"))
        .select(col, "total", share_pct("total", whole).alias("pct"))
    )


def review_distribution(reviews: DataFrame) -> DataFrame:
    return _distribution(reviews, "review_score").orderBy("review_score")


def order_status(orders: DataFrame) -> DataFrame:
    return _distribution(orders, "order_status").orderBy(F.desc("total"), "order_status")


def review_by_category(
    fact: DataFrame, reviews: DataFrame, min_reviews: int = 100, n: int = 15
) -> DataFrame:
    """Mean score over every (item, review) pair of a category.

    The pairs themselves are never formed: an order contributes its items per
    category times its reviews, so an order with many of both costs one row.
    """
    items = fact.groupBy("order_id", _category()).agg(F.count(F.lit(1)).alias("items"))
    scores = reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count("review_score").alias("scored"),
        F.sum("review_score").alias("score"),
    )
    return (
        items.join(scores, "order_id")
        .groupBy("category")
        .agg(
            F.sum(F.col("items") * F.col("score")).alias("score"),
            F.sum(F.col("items") * F.col("scored")).alias("scored"),
            F.sum(F.col("items") * F.col("reviews")).alias("num_reviews"),
        )
        .where(F.col("num_reviews") >= min_reviews)
        .select(
            "category", round_half_up(ratio("score", "scored")).alias("avg_score"), "num_reviews"
        )
        .orderBy(F.desc("avg_score"), "category")
        .limit(n)
    )


def avg_delivery(orders: DataFrame) -> DataFrame:
    """Mean of fractional days from purchase to delivery; seconds are summed exactly."""
    seconds = seconds_between("order_delivered_customer_date", "order_purchase_timestamp")
    return (
        orders.where(F.col("order_delivered_customer_date").isNotNull())
        .agg(F.sum(seconds).alias("seconds"), F.count(seconds).alias("n"))
        .select(
            round_half_up(ratio("seconds", F.col("n") * SECONDS_PER_DAY)).alias("avg_delivery_days")
        )
    )


def delivery_days(orders: DataFrame) -> DataFrame:
    """delivery_days of each delivered order, in whole days rounded down."""
    return orders.where(F.col("order_delivered_customer_date").isNotNull()).select(
        whole_days_between("order_delivered_customer_date", "order_purchase_timestamp").alias(
            "delivery_days"
        )
    )


def segment_summary(segments: DataFrame) -> DataFrame:
    def mean_of(c: str) -> Column:
        return round_half_up(ratio(F.sum(c), F.count(c))).alias(f"avg_{c}")

    return (
        segments.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            mean_of("recency"),
            mean_of("frequency"),
            mean_of("monetary"),
        )
        .orderBy(F.desc("avg_monetary"), "segment")
    )


def segment_lookup(segments: DataFrame, customer: str) -> DataFrame:
    """The segment row of one customer, or none."""
    return segments.where(F.col("customer_unique_id") == customer).select(
        "customer_unique_id", "segment", "recency", "frequency", "monetary"
    )


def churn_lookup(churn: DataFrame, customer: str) -> DataFrame:
    """The churn row of one customer, or none."""
    return churn.where(F.col("customer_unique_id") == customer).select(
        "customer_unique_id",
        "recency",
        "frequency",
        "monetary",
        "churn_probability",
        "churn_prediction",
    )


def top_risk(churn: DataFrame, n: int = 20) -> DataFrame:
    """Predicted churners, most probable first."""
    return (
        churn.where("churn_prediction = 1")
        .select("customer_unique_id", "recency", "frequency", "monetary", "churn_probability")
        .orderBy(F.desc("churn_probability"), "customer_unique_id")
        .limit(n)
    )


def churn_summary(churn: DataFrame) -> DataFrame:
    """Customers, churned ones, mean probability, and churn rates as known and as predicted."""
    return churn.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("churn").alias("churned"),
        round_half_up(F.avg("churn_probability"), 4).alias("avg_prob"),
        share_pct(F.sum("churn"), F.count("churn")).alias("actual_rate"),
        share_pct(F.sum("churn_prediction"), F.count("churn_prediction")).alias("predicted_rate"),
    )


def churn_bands(churn: DataFrame) -> DataFrame:
    """Adds band: high above 0.7, medium above 0.4, else low."""
    p = F.col("churn_probability")
    return churn.withColumn(
        "band", F.when(p > 0.7, "high").when(p > 0.4, "medium").otherwise("low")
    )


def popular_products_top(popular: DataFrame, n: int = 20) -> DataFrame:
    return (
        popular.select("product_id", "category", "n_purchases", "n_customers")
        .orderBy(F.desc("n_customers"), F.desc("n_purchases"), "product_id")
        .limit(n)
    )

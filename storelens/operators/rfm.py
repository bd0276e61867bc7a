"""Recency, frequency and monetary value per customer, and their quartile scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import whole_days_between
from storelens.functions.quantiles import QUARTILES, exact_quantiles
from storelens.functions.ranking import global_rank
from storelens.session import materialize

SCORES = ("R_score", "F_score", "M_score")


def snapshot(fact: DataFrame) -> Column:
    """One day after the last purchase, as a scalar subquery."""
    last = F.max("order_purchase_timestamp")
    return fact.agg((last + F.expr("INTERVAL 1 DAY")).alias("snapshot")).scalar()


def per_order(fact: DataFrame) -> DataFrame:
    """One row per customer and order: purchase date and amount."""
    return fact.groupBy("customer_unique_id", "order_id").agg(
        F.max("order_purchase_timestamp").alias("order_purchase_timestamp"),
        F.sum("total_amount").alias("total_amount"),
    )


def rfm(fact: DataFrame) -> DataFrame:
    """customer_unique_id, recency (whole days), frequency (orders), monetary.

    monetary stays as exact as the amounts are; without any amount it is 0. Without any
    purchase date recency is NULL.
    """
    return rfm_of_orders(per_order(fact))


def rfm_of_orders(orders: DataFrame) -> DataFrame:
    """rfm from the rows of per_order.

    The totals are written, unknown customers among them: the last purchase of all is read off them.
    """
    amount = orders.schema["total_amount"].dataType  # a sum already
    totals = materialize(
        orders.groupBy("customer_unique_id").agg(
            F.max("order_purchase_timestamp").alias("order_purchase_timestamp"),
            F.count("order_id").alias("frequency"),
            F.coalesce(F.sum("total_amount").cast(amount), F.lit(0)).alias("monetary"),
        ),
        "customer-totals",
    )
    return totals.where(F.col("customer_unique_id").isNotNull()).select(
        "customer_unique_id",
        whole_days_between(snapshot(totals), "order_purchase_timestamp").alias("recency"),
        "frequency",
        "monetary",
    )


def _bin(value: Column, edges: list[Column], scores: list[int]) -> Column:
    """Right-closed bins; equal edges leave a bin empty, its values fall in the lower one.

    No value, no score.
    """
    out = F.when(value.isNull(), None).when(value <= edges[0], scores[0])
    for edge, score in zip(edges[1:], scores[1:]):
        out = out.when(value <= edge, score)
    return out.otherwise(F.lit(scores[-1])).cast("int")


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """Adds R_score (recent is 4), F_score, M_score and their concatenation RFM_score.

    Recency and amount are cut at their quartiles. Frequency is cut at the
    quartiles of its rank with ties by customer id, because most customers share
    one value. A customer without a recency has neither R_score nor RFM_score.
    """
    ranked = global_rank(rfm, ["frequency", "customer_unique_id"], "_rank", "frequency-rank")
    # day counts have few distinct values, so the built-in exact percentile holds them easily
    days = rfm.agg(F.percentile("recency", F.array(*map(F.lit, QUARTILES))).alias("q"))
    amounts = exact_quantiles(rfm, ["monetary"])
    n = rfm.agg(F.count(F.lit(1))).scalar()
    recency_edges = [days.select(F.col("q")[i]).scalar() for i in range(3)]
    amount_edges = [amounts.select(f"q{i}").scalar() for i in range(3)]
    rank_edges = [1 + (n - 1) * F.lit(q) for q in QUARTILES]
    scored = ranked.withColumns(
        {
            "R_score": _bin(F.col("recency"), recency_edges, [4, 3, 2, 1]),
            "F_score": _bin(F.col("_rank"), rank_edges, [1, 2, 3, 4]),
            "M_score": _bin(F.col("monetary").cast("double"), amount_edges, [1, 2, 3, 4]),
        }
    ).drop("_rank")
    return scored.withColumn("RFM_score", F.concat(*[F.col(c).cast("string") for c in SCORES]))

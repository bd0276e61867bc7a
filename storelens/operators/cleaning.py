"""Cleaning of the raw tables and the scalar features of an order line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.skew import left_join

# The date columns of an order.
ORDER_DATES = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
# Weekdays in calendar order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
UNKNOWN = "unknown"


def clean_orders(orders: DataFrame) -> DataFrame:
    """Dates as zoneless timestamps; a value that is no date becomes NULL."""
    return orders.withColumns(
        {c: F.col(c).try_cast("timestamp_ntz") for c in ORDER_DATES if c in orders.columns}
    )


def clean_products(products: DataFrame) -> DataFrame:
    return products.fillna({"product_category_name": UNKNOWN})


def add_category_translation(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Adds product_category_name_english, `unknown` where there is no translation."""
    return left_join(products, translation, "product_category_name").fillna(
        {"product_category_name_english": UNKNOWN}
    )


def date_features(df: DataFrame, ts_col: str = "order_purchase_timestamp") -> DataFrame:
    """Adds year, month, quarter, year_month and day_of_week; all NULL for a missing date.

    None of them goes through the session time zone, in which some local times
    do not exist.
    """
    names = F.array(*[F.lit(day) for day in WEEKDAYS])
    return df.withColumns(
        {
            "year": F.year(ts_col),
            "month": F.month(ts_col),
            "quarter": F.quarter(ts_col),
            "year_month": F.substring(F.col(ts_col).cast("string"), 1, 7),
            # element_at over literals takes its index for known, so ask first
            "day_of_week": F.when(
                F.col(ts_col).isNotNull(), F.element_at(names, F.weekday(ts_col) + 1)
            ),
        }
    )


def payment_rollup(payments: DataFrame) -> DataFrame:
    """One row per order: its first type, most installments and total value.

    First means the first non-null type by payment_sequential; without that
    column a table has no order, and the smallest type is taken. An order with
    no known value totals 0.
    """
    kind = F.col("payment_type")
    if "payment_sequential" in payments.columns:
        first = F.min_by(kind, F.when(kind.isNotNull(), F.struct("payment_sequential", kind)))
    else:
        first = F.min(kind)
    return (
        payments.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            first.alias("payment_type"),
            F.max("payment_installments").alias("payment_installments"),
            F.coalesce(F.sum("payment_value"), F.lit(0)).alias("payment_value"),
        )
    )

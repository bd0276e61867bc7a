"""Assertions on the stored tables, as rows of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables a complete build leaves behind.
EXPECTED_TABLES = (
    "fact_sales",
    "dim_customers",
    "dim_products",
    "dim_sellers",
    "orders",
    "reviews",
    "payments",
    "customer_segments",
    "customer_churn",
    "popular_products",
    "recommendations",
)
# The columns every reader of the fact table relies on.
REQUIRED_FACT_COLUMNS = (
    "order_id",
    "customer_unique_id",
    "product_id",
    "total_amount",
    "order_purchase_timestamp",
)


def missing_tables(tables: dict[str, DataFrame], expected: tuple[str, ...] = EXPECTED_TABLES) -> list[str]:
    return [name for name in expected if name not in tables]


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_FACT_COLUMNS) -> list[str]:
    return [name for name in required if name not in df.columns]


def expected_tables(
    tables: dict[str, DataFrame], spark: SparkSession, expected: tuple[str, ...] = EXPECTED_TABLES
) -> DataFrame:
    """check, ok, observed: a row for each expected table, and whether it is there."""
    absent = set(missing_tables(tables, expected))
    return spark.createDataFrame(
        [(f"table_{name}", name not in absent, "absent" if name in absent else "present") for name in expected], "check string, ok boolean, observed string")


def required_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_FACT_COLUMNS) -> DataFrame:
    """check, ok, observed: a row for each required column, whether it is there, and its values that are not NULL."""
    absent = set(missing_columns(df, required))
    return _report(df, {
        f"column_{name}": (F.lit(None), F.lit(False)) if name in absent
        else (F.count(F.col(f"`{name}`")), F.lit(True)) for name in required})


def _report(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """check, ok, observed from aggregates: name -> (observed, whether that is fine)."""
    row = df.agg(*[
        F.struct(
            F.lit(name).alias("check"), ok.alias("ok"), observed.cast("string").alias("observed")
        ).alias(name)
        for name, (observed, ok) in checks.items()
    ])
    return row.select(F.inline(F.array(*[F.col(f"`{name}`") for name in checks])))


def dq_report(tables: dict[str, DataFrame], min_segments: int = 4) -> DataFrame:
    """check, ok, observed for each table that is given; one pass per table."""
    parts = []
    if "fact_sales" in tables:
        rows, revenue = F.count(F.lit(1)), F.round(F.sum("total_amount"), 2).cast("decimal(38,2)")
        nulls = F.count_if(F.col("total_amount").isNull())
        parts.append(_report(tables["fact_sales"], {
            "fact_not_empty": (rows, rows > 0),
            "revenue_positive": (revenue, F.coalesce(revenue > 0, F.lit(False))),
            "no_null_total": (nulls, nulls == 0),
        }))
    if "customer_segments" in tables:
        kinds = F.countDistinct("segment")
        vip = F.count_if(F.col("segment") == "VIP")
        parts.append(_report(tables["customer_segments"], {
            "enough_segments": (kinds, kinds >= min_segments),
            "has_vip": (vip, vip > 0),
        }))
    if "customer_churn" in tables:
        outside = F.count_if(~F.col("churn_probability").between(0, 1))
        parts.append(_report(tables["customer_churn"], {
            "probability_in_range": (outside, outside == 0),
        }))
    return reduce(DataFrame.unionByName, parts)

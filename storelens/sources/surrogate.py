"""The nine raw tables expressed over the order-line test tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Raw table name -> DataFrame; lazy apart from reading the file footers."""
    return {
        "customers": customers(spark, folder),
        "orders": orders(spark, folder),
        "order_items": order_items(spark, folder),
        "payments": payments(spark, folder),
        "reviews": reviews(spark, folder),
        "products": products(spark, folder),
        "sellers": sellers(spark, folder),
        "geolocation": geolocation(spark, folder),
        "category_translation": category_translation(spark, folder),
    }


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """25 nations with their region."""
    nation, region = _read(spark, folder, "nation"), _read(spark, folder, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left").select(
        "n_nationkey", "n_name", "r_name"
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    customer, place = _read(spark, folder, "customer"), _places(spark, folder)
    return customer.join(place, customer["c_nationkey"] == place["n_nationkey"], "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_unique_id"),
        F.col("n_name").alias("customer_city"),
        F.col("r_name").alias("customer_state"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    order = _read(spark, folder, "orders")
    shipped = (
        _read(spark, folder, "lineitem")
        .select("l_orderkey", "l_shipdate")
        .distinct()
        .join(order.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .where("l_shipdate >= o_orderdate")
        .groupBy(F.col("l_orderkey").alias("_order"))
        .agg(F.min("l_shipdate").alias("_delivered"))
    )
    return order.join(shipped, order["o_orderkey"] == shipped["_order"], "left").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END").alias(
            "order_approved_at"
        ),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END").alias(
            "order_delivered_carrier_date"
        ),
        F.col("_delivered").alias("order_delivered_customer_date"),
        F.expr("o_orderdate + INTERVAL 30 DAY").alias("order_estimated_delivery_date"),
    )


def orders_as_text(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a CSV would deliver them: dates as text, some of them unusable."""
    return _read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").cast("string").alias("order_purchase_timestamp"),
        F.expr(
            "CASE WHEN o_orderstatus = 'P' THEN o_orderpriority "
            "ELSE CAST(o_orderdate AS STRING) END"
        ).alias("order_approved_at"),
        F.expr(
            "CASE WHEN o_orderstatus = 'F' THEN CAST(to_date(o_orderdate) AS STRING) "
            "WHEN o_orderstatus = 'O' THEN 'not a date' END"
        ).alias("order_delivered_carrier_date"),
        F.lit(None).cast("string").alias("order_delivered_customer_date"),
        F.to_date("o_orderdate").cast("string").alias("order_estimated_delivery_date"),
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return _read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).alias("freight_value"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    order = _read(spark, folder, "orders")
    paid = F.array(
        F.struct(
            F.lit(1).alias("payment_sequential"),
            F.col("o_orderpriority").alias("payment_type"),
            (1 + F.col("o_orderkey") % 12).cast("int").alias("payment_installments"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"),
        )
    )
    voucher = F.array(
        F.struct(
            F.lit(2).alias("payment_sequential"),
            F.lit("voucher").alias("payment_type"),
            F.lit(1).alias("payment_installments"),
            F.lit("10.00").cast("decimal(12,2)").alias("payment_value"),
        )
    )
    rows = F.when(F.col("o_orderkey") % 10 == 0, F.concat(paid, voucher)).otherwise(paid)
    return order.select(F.col("o_orderkey").alias("order_id"), F.inline(rows))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "events").select(
        F.col("event_id").alias("review_id"),
        (F.col("event_id") - F.col("event_id") % 2).alias("order_id"),
        (1 + F.floor("value") % 5).cast("int").alias("review_score"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.expr("CASE WHEN p_brand <> 'Brand#13' THEN p_brand END").alias("product_category_name"),
        F.col("p_size").cast("double").alias("product_weight_g"),
        (F.col("p_size") * 2).cast("double").alias("product_length_cm"),
        F.lit(None).cast("double").alias("product_height_cm"),
        F.col("p_retailprice").alias("product_width_cm"),
    )


def category_translation(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _read(spark, folder, "part")
        .where("p_brand NOT IN ('Brand#10', 'Brand#20')")
        .select(
            F.col("p_brand").alias("product_category_name"),
            F.expr("concat('category_', substr(p_brand, 7))").alias("product_category_name_english"),
        )
        .distinct()
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    supplier, place = _read(spark, folder, "supplier"), _places(spark, folder)
    return supplier.join(place, supplier["s_nationkey"] == place["n_nationkey"], "left").select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("n_name").alias("seller_city"),
        F.col("r_name").alias("seller_state"),
    )


def geolocation(spark: SparkSession, folder: str) -> DataFrame:
    return _places(spark, folder).select(
        F.col("n_name").alias("geolocation_city"), F.col("r_name").alias("geolocation_state")
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions to the assistant: what users said, and one phrased from each product."""
    said = (
        _read(spark, folder, "conversations")
        .where("role = 'user'")
        .select(
            F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("question_id"),
            F.col("text").alias("question"),
        )
    )
    size = F.col("p_size").cast("string")
    phrased = _read(spark, folder, "part").select(
        F.concat_ws("-", F.lit("p"), "p_partkey").alias("question_id"),
        F.concat(
            F.element_at(
                F.array(
                    F.concat(F.lit("Top "), size, F.lit(" catégories par revenu")),
                    F.concat(F.lit("Quelle ville a le plus de ventes en "), 1990 + F.col("p_size"), F.lit(" ?")),
                    F.concat(F.lit("أفضل "), size, F.lit(" منتجات")),
                    F.concat(F.lit("Les "), size, F.lit(" meilleurs clients")),
                    F.concat(F.lit("Payment methods by value for "), F.col("p_name")),
                    F.concat(F.lit("Show the review score of "), F.col("p_name")),
                    F.concat(F.lit("Meilleurs"), size, F.lit(" segments")),
                    F.concat(F.lit("Revenue per MONTH, rows "), size),
                ),
                (F.col("p_partkey") % 8 + 1).cast("int"),
            )
        ).alias("question"),
    )
    return said.unionByName(phrased)

"""The star schema: one fact row per order item, three dimensions, four tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.skew import left_join, spread_rows
from storelens.operators.cleaning import (
    add_category_translation,
    clean_orders,
    clean_products,
    date_features,
    payment_rollup,
)
from storelens.operators.rfm import per_order
from storelens.session import materialize


def build_fact_sales(
    orders: DataFrame,
    order_items: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
) -> DataFrame:
    """Order items with their order, product, customer, date parts and payment.

    Customer and payment are joined to the orders first, at order grain, so the
    items, the largest input, move at most once per remaining key.
    """
    per_order = left_join(
        spread_rows(orders),
        customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state"),
        "customer_id",
    ).drop("_spread")
    per_order = per_order.join(payment_rollup(payments), "order_id", "left")

    items = spread_rows(order_items)
    items = left_join(
        items,
        products.select(
            "product_id", "product_category_name", "product_category_name_english"
        ),
        "product_id",
    )
    fact = left_join(items, per_order, "order_id", known_large=True, hot_in=order_items).drop("_spread")
    fact = fact.withColumn("total_amount", F.col("price") + F.col("freight_value"))
    fact = date_features(fact, "order_purchase_timestamp")

    order_columns = [c for c in orders.columns if c != "order_id"]
    return fact.select(
        *order_items.columns,
        *order_columns,
        "product_category_name",
        "product_category_name_english",
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "total_amount",
        "year",
        "month",
        "quarter",
        "year_month",
        "day_of_week",
        "payment_type",
        "payment_installments",
        "payment_value",
    )


def _owned(orders: DataFrame, customers: DataFrame, *cols: str) -> DataFrame:
    """Orders with customer_unique_id, and of their own columns only order_id and cols."""
    orders = orders.select("order_id", "customer_id", *cols)
    people = customers.select("customer_id", "customer_unique_id")
    return left_join(orders, people, "customer_id", hot_in=orders).drop("customer_id")


def build_customer_orders(
    orders: DataFrame, order_items: DataFrame, products: DataFrame, customers: DataFrame
) -> DataFrame:
    """`per_order` of the fact table, without building it: amounts are summed per order first.

    Items meet the products only if one of these is listed twice, which repeats its items.
    """
    items = order_items.select(
        "order_id", "product_id", (F.col("price") + F.col("freight_value")).alias("total_amount")
    )
    listed = products.where(F.col("product_id").isNotNull()).groupBy("product_id")
    if not listed.agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        items = left_join(items, products.select("product_id"), "product_id", hot_in=order_items)
    amounts = items.groupBy("order_id").agg(F.sum("total_amount").alias("total_amount"))
    kind = amounts.schema["total_amount"].dataType
    totals = per_order(_owned(orders, customers, "order_purchase_timestamp").join(amounts, "order_id"))
    return totals.withColumn("total_amount", F.col("total_amount").cast(kind))


def build_purchases(
    orders: DataFrame, order_items: DataFrame, products: DataFrame, customers: DataFrame
) -> DataFrame:
    """The rows of the fact table with customer, order, product and category only.

    No row carries a number for salting: a left side with a hot key is written before it is salted.
    """
    items = order_items.select("order_id", "product_id")
    kinds = products.select("product_id", "product_category_name_english")
    items = left_join(items, kinds, "product_id", hot_in=order_items)
    return left_join(items, _owned(orders, customers), "order_id", known_large=True, hot_in=order_items)


def build_order_rows(
    orders: DataFrame, order_items: DataFrame, products: DataFrame, customers: DataFrame, payments: DataFrame
) -> DataFrame:
    """The rows of the fact table whose order is known, with the columns that customers are described by.

    Items meet their order last, so what is grouped by order next does not move again.
    """
    items = order_items.select(
        "order_id", "order_item_id", "product_id", "seller_id", "freight_value",
        (F.col("price") + F.col("freight_value")).alias("total_amount"),
    )
    kinds = products.select("product_id", "product_category_name_english")
    items = left_join(items, kinds, "product_id", hot_in=order_items)
    owned = _owned(orders, customers, "order_purchase_timestamp")
    paid = payment_rollup(payments).select("order_id", "payment_type", "payment_installments")
    owned = owned.join(paid, "order_id", "left")
    return left_join(items, owned, "order_id", "inner", known_large=True, hot_in=order_items)


def build_dim_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state"
    ).dropDuplicates()


def build_dim_products(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id",
        "product_category_name",
        "product_category_name_english",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    ).dropDuplicates()


def build_dim_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", "seller_city", "seller_state").dropDuplicates()


def build_warehouse(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All eight tables from the nine raw ones.

    Orders and products are written first: the joins below salt their rows by position, which
    must not change when a task is run again.
    """
    orders = materialize(clean_orders(raw["orders"]), "orders")
    products = materialize(
        add_category_translation(clean_products(raw["products"]), raw["category_translation"]),
        "products",
    )
    return {
        "fact_sales": build_fact_sales(
            orders, raw["order_items"], products, raw["customers"], raw["payments"]
        ),
        "dim_customers": build_dim_customers(raw["customers"]),
        "dim_products": build_dim_products(products),
        "dim_sellers": build_dim_sellers(raw["sellers"]),
        "orders": orders,
        "reviews": raw["reviews"],
        "payments": raw["payments"],
        "geolocation": raw["geolocation"],
    }

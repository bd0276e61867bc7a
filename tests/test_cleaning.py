from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from storelens.functions.columns import (
    round_half_even,
    round_half_up,
    short_id,
    whole_days_between,
)
from storelens.operators import cleaning, star


def test_bad_dates_become_null(spark):
    rows = [("2018-01-05 10:00:00",), ("not a date",), (None,)]
    out = cleaning.clean_orders(spark.createDataFrame(rows, "order_purchase_timestamp string"))
    assert [r[0] for r in out.collect()] == [dt.datetime(2018, 1, 5, 10), None, None]
    assert out.schema[0].dataType.simpleString() == "timestamp_ntz"


def test_cleaning_leaves_its_input_alone(spark):
    orders = spark.createDataFrame([("x",)], "order_purchase_timestamp string")
    cleaning.clean_orders(orders)
    assert orders.first()[0] == "x"


def test_date_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        # 00:30 on this day does not exist on clocks in that zone
        orders = spark.createDataFrame(
            [("2018-11-04 00:30:00", "2018-11-05 00:30:00")],
            "order_purchase_timestamp string, order_delivered_customer_date string",
        )
        clean = cleaning.date_features(cleaning.clean_orders(orders))
        days = whole_days_between("order_delivered_customer_date", "order_purchase_timestamp")
        row = clean.select("order_purchase_timestamp", "year_month", "day_of_week", days.alias("d")).first()
        assert tuple(row) == (dt.datetime(2018, 11, 4, 0, 30), "2018-11", "Sunday", 1.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_missing_timestamp_has_null_parts(spark):
    df = spark.createDataFrame([(None,)], "order_purchase_timestamp timestamp_ntz")
    row = cleaning.date_features(df).first()
    assert row["year"] is None and row["year_month"] is None and row["day_of_week"] is None


def test_weekday_is_spelled_out(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 10, 17, 17, 30),)], "t timestamp_ntz")
    row = cleaning.date_features(df, "t").first()
    assert tuple(row)[1:] == (2018, 10, 4, "2018-10", "Wednesday")


def test_rounding(spark):
    row = spark.range(1).select(
        round_half_up(F.lit(0.125)), round_half_even(F.lit(0.125)), round_half_up(F.lit(-0.125))
    ).first()
    assert tuple(row) == (0.13, 0.12, -0.13)


def test_whole_days_round_down(spark):
    def days(later, earlier):
        df = spark.createDataFrame(
            [(dt.datetime.fromisoformat(later), dt.datetime.fromisoformat(earlier))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        return df.select(whole_days_between("a", "b")).first()[0]

    assert days("2018-01-01 10:00", "2018-01-01 12:00") == -1
    assert days("2018-01-02 01:00", "2018-01-01 23:00") == 0
    assert days("2018-01-03 23:00", "2018-01-01 23:00") == 2


def test_short_id(spark):
    assert spark.range(1).select(short_id(F.lit("abcdefghijklmnop"), 10)).first()[0] == "abcdefghij..."


def test_translation(spark):
    products = spark.createDataFrame([("p1", "moveis"), ("p2", None), ("p3", "xyz")],
                                     "product_id string, product_category_name string")
    words = spark.createDataFrame([("moveis", "furniture")],
                                  "product_category_name string, product_category_name_english string")
    out = cleaning.add_category_translation(cleaning.clean_products(products), words)
    found = {r["product_id"]: (r["product_category_name"], r["product_category_name_english"])
             for r in out.collect()}
    assert found == {"p1": ("moveis", "furniture"), "p2": ("unknown", "unknown"), "p3": ("xyz", "unknown")}


PAYMENTS = "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(17,4)"


def test_payment_rollup(spark):
    rows = [
        ("a", 2, "voucher", 1, Decimal("10")),
        ("a", 1, "credit_card", 3, Decimal("20.5")),
        ("b", 1, None, 1, Decimal("5")),
        ("b", 2, "boleto", 2, Decimal("6")),
        ("c", 1, "debit", 1, None),
        (None, 1, "debit", 1, Decimal("1")),
    ]
    out = cleaning.payment_rollup(spark.createDataFrame(rows, PAYMENTS))
    found = {r["order_id"]: tuple(r)[1:] for r in out.collect()}
    assert found == {
        "a": ("credit_card", 3, Decimal("30.5")),
        "b": ("boleto", 2, Decimal("11")),
        "c": ("debit", 1, Decimal("0")),
    }


def test_rollup_without_sequence_takes_the_smallest_type(spark):
    rows = [("a", "voucher", 1, Decimal("1")), ("a", "boleto", 2, Decimal("2"))]
    df = spark.createDataFrame(
        rows, "order_id string, payment_type string, payment_installments int, payment_value decimal(17,4)")
    assert cleaning.payment_rollup(df).first()["payment_type"] == "boleto"


def test_fact_keeps_every_item(spark):
    orders = spark.createDataFrame(
        [("o1", "c1", "2018-01-05 10:00:00"), ("o2", "c9", "bad")],
        "order_id string, customer_id string, order_purchase_timestamp string")
    items = spark.createDataFrame(
        [("o1", 1, "p1", "s1", Decimal("1.5"), Decimal("0.25")),
         ("o1", 2, "p9", "s1", Decimal("2"), Decimal("0")),
         ("o2", 1, "p1", "s1", Decimal("3"), Decimal("1")),
         ("o9", 1, "p1", "s1", Decimal("4"), Decimal("1")),
         (None, 1, "p1", "s1", Decimal("5"), Decimal("1"))],
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "price decimal(17,4), freight_value decimal(17,4)")
    products = spark.createDataFrame(
        [("p1", "moveis", "furniture")],
        "product_id string, product_category_name string, product_category_name_english string")
    customers = spark.createDataFrame(
        [("c1", "u1", "sao paulo", "SP")],
        "customer_id string, customer_unique_id string, customer_city string, customer_state string")
    payments = spark.createDataFrame([("o1", 1, "boleto", 1, Decimal("9"))], PAYMENTS)
    fact = star.build_fact_sales(cleaning.clean_orders(orders), items, products, customers, payments)
    rows = {(r["order_id"], r["order_item_id"]): r for r in fact.collect()}
    assert len(rows) == 5
    first = rows["o1", 1]
    assert (first["total_amount"], first["customer_unique_id"], first["payment_type"]) == (
        Decimal("1.75"), "u1", "boleto")
    assert rows["o1", 2]["product_category_name_english"] is None
    assert rows["o2", 1]["year_month"] is None and rows["o2", 1]["customer_unique_id"] is None
    assert rows["o9", 1]["customer_id"] is None
    assert "_spread" not in fact.columns

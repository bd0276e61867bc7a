from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storelens.operators import eda, quality, questions, recommend, rfm, sales, star
from storelens.operators.cleaning import clean_orders
from storelens.plans.mart import Mart


def item(order, customer, amount, day="2018-01-01 00:00:00", **more):
    return {"order_id": order, "customer_unique_id": customer, "total_amount": amount,
            "order_purchase_timestamp": day, "year_month": day[:7] if day else None, **more}


def test_kpis_count_orders_once(make_fact):
    fact = make_fact([item("o1", "a", 10), item("o1", "a", 5.25), item("o2", "b", 1)])
    assert tuple(sales.kpis(fact).first()) == (16.25, 2, 2, 8.13)


def test_newest_customer_recency(make_fact):
    fact = make_fact([item("o1", "a", 1, "2018-10-17 17:30:18"), item("o2", "b", 1, "2018-10-15 18:00:00")])
    by_sql = {r[0]: r[1] for r in sales.rfm_sql(fact).collect()}
    by_frame = {r[0]: r[1] for r in rfm.rfm(fact).collect()}
    assert by_sql == {"a": 0, "b": 2}
    assert by_frame == {"a": 1, "b": 2}


def test_null_customer_is_a_group_in_sql_only(make_fact):
    fact = make_fact([item("o1", None, 5), item("o2", "a", 1)])
    assert {r[0] for r in sales.rfm_sql(fact).collect()} == {None, "a"}
    assert {r[0] for r in rfm.rfm(fact).collect()} == {"a"}


def test_two_cities_are_two_rows(make_fact):
    fact = make_fact([
        item("o1", "a", 5, customer_city="x", customer_state="S"),
        item("o2", "a", 7, customer_city="y", customer_state="S"),
    ])
    assert sales.top_customers(fact).count() == 2
    assert rfm.rfm(fact).count() == 1


def test_reviews_fan_out_over_items(spark, make_fact):
    fact = make_fact([item("o1", "a", 1, product_category_name_english="c"),
                      item("o1", "a", 1, product_category_name_english="c"),
                      item("o2", "a", 1, product_category_name_english="d")])
    reviews = spark.createDataFrame([("r1", "o1", 5), ("r2", "o1", 2), ("r3", "o2", 4)],
                                    "review_id string, order_id string, review_score int")
    assert [tuple(r) for r in sales.review_by_category(fact, reviews, 2).collect()] == [("c", 3.5, 4)]
    both = [tuple(r) for r in sales.review_by_category(fact, reviews, 1).collect()]
    assert both == [("d", 4.0, 1), ("c", 3.5, 4)]


def test_delivery_statistics(spark):
    rows = [(dt.datetime(2018, 1, 1, 12), dt.datetime(2018, 1, 1, 10)),
            (dt.datetime(2018, 1, 1, 23), dt.datetime(2018, 1, 2, 1)),
            (dt.datetime(2018, 1, 1), dt.datetime(2018, 1, 4)),
            (dt.datetime(2018, 1, 1), None)]
    orders = spark.createDataFrame(
        rows, "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz")
    assert tuple(eda.delivery_stats(orders).first()) == (2 / 3, 0.0, 3)
    assert sales.avg_delivery(orders).first()[0] == 1.0


def test_monthly_since_skips_missing_dates(make_fact):
    fact = make_fact([item("o1", "a", 1, "2016-12-31"), item("o2", "a", 2, "2017-01-01"), item("o3", "a", 4, None)])
    assert [r[0] for r in sales.monthly_sales(fact, "2017-01").collect()] == ["2017-01"]
    assert [r[0] for r in sales.monthly_sales(fact).collect()] == [None, "2016-12", "2017-01"]


def test_quartile_sizes_follow_the_rank(make_fact):
    for n, sizes in ((6, [2, 1, 1, 2]), (10, [3, 2, 2, 3])):
        fact = make_fact([item(f"o{i}", f"c{i:02d}", i + 1, f"2018-01-{i + 1:02d}") for i in range(n)])
        scores = rfm.rfm_scores(rfm.rfm(fact))
        counted = {r[0]: r[1] for r in scores.groupBy("F_score").count().collect()}
        assert [counted.get(s, 0) for s in (1, 2, 3, 4)] == sizes


def test_equal_quartile_edges_fall_into_the_lower_bin(spark):
    from decimal import Decimal

    amounts = [1, 1, 1, 1, 1, 1, 2, 3]
    df = spark.createDataFrame([(f"c{i}", i, 1, Decimal(a)) for i, a in enumerate(amounts)],
                               "customer_unique_id string, recency int, frequency bigint, monetary decimal(18,4)")
    scores = {r["customer_unique_id"]: r["M_score"] for r in rfm.rfm_scores(df).collect()}
    assert [scores[f"c{i}"] for i in range(8)] == [1, 1, 1, 1, 1, 1, 4, 4]


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (None, None, 1.0)], "a int, b string, c double")
    assert [tuple(r) for r in eda.missing_values(df).collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_weekdays_are_complete(make_fact):
    out = eda.orders_by_weekday(make_fact([item("o1", "a", 1, day_of_week="Sunday")])).collect()
    assert [r["day_of_week"] for r in out] == list(eda.WEEKDAYS)
    assert [r["orders"] for r in out] == [0, 0, 0, 0, 0, 0, 1]


def test_describe_matches_pandas(spark):
    import pandas as pd

    values = [1.5, 2.0, 7.25, 3.0, 3.0, 10.0]
    row = eda.describe(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).first()
    assert list(row)[1:] == list(pd.Series(values).describe().round(2))


def test_box_whiskers_stop_at_the_fence(spark):
    df = spark.createDataFrame([("x", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    assert tuple(eda.box_stats(df, "v", "g").first()) == ("x", 2.25, 3.5, 4.75, 1.0, 5.0)


def test_category_matrix_fills_zero(make_fact):
    fact = make_fact([
        item("o1", "a", 5, "2018-01-01", month=1, product_category_name_english="c"),
        item("o2", "a", 7, "2018-03-01", month=3, product_category_name_english="d"),
        item("o3", "a", 9, "2018-03-01", month=3),
    ])
    out = [tuple(r) for r in eda.category_month_matrix(fact, 1).collect()]
    assert out == [("d", 0.0, 0.0, 7.0, *[0.0] * 9)]


def test_top_categories_cut_is_stable(make_fact):
    fact = make_fact([item(f"o{i}", "a", 1, product_category_name_english=f"c{i}") for i in range(9)])
    assert [r[0] for r in sales.top_categories(fact.repartition(5), 3).collect()] == ["c0", "c1", "c2"]


def test_quality_report(spark, make_fact):
    good = quality.dq_report({"fact_sales": make_fact([item("o1", "a", 5)])})
    assert all(r["ok"] for r in good.collect())
    bad = {r["check"]: r["ok"] for r in quality.dq_report({
        "fact_sales": make_fact([item("o1", "a", None)]),
        "customer_segments": spark.createDataFrame([("Lost",)], "segment string"),
        "customer_churn": spark.createDataFrame([(1.5,)], "churn_probability double"),
    }).collect()}
    assert bad == {"fact_not_empty": True, "revenue_positive": False, "no_null_total": False,
                   "enough_segments": False, "has_vip": False, "probability_in_range": False}
    assert quality.missing_tables({"orders": None}, ("orders", "reviews")) == ["reviews"]
    assert quality.missing_columns(make_fact([]), ("order_id", "nope")) == ["nope"]


def ask(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "question string")


def test_requested_number(spark):
    texts = {"Top 5 catégories": 5, "أفضل 5 فئات": 5, "أفضل ٧ فئات": 7, "ventes in 2018": None, "no number": None,
             "les 3 premiers 12 clients": 12, "show 40 rows": 40, "top 0": None, "top 500": 500, "2018 top": None,
             "les 12 mois": 12}
    out = questions.question_top_n(ask(spark, texts)).collect()
    assert {r["question"]: r["requested_n"] for r in out} == texts


def test_topics(spark):
    texts = {"Top 5 CATÉGORIES par ville": "category", "which city": "city", "منتجات": "product", "our clients": "customer",
             "payment": "payment", "une note": "review", "segments": "segment", "par mois": "month", "hello": "other"}
    out = questions.question_topics(ask(spark, texts)).collect()
    assert {r["question"]: r["topic"] for r in out} == texts


def test_formatting(spark):
    df = spark.createDataFrame([("a", 1234567, 1234567.891, 45.5, 2345.0, 12345, "x")],
                               "name string, orders bigint, revenue double, pct double, score double, total int, note string")
    out = questions.format_results(df)
    assert tuple(out.first()) == ("a", "1 234 567", "1 234 567.89 BRL", "45.50%", "2 345.00", "12 345", "x")
    line = out.select(questions.answer_lines(out)).first()[0]
    assert line.startswith("**a** — **1 234 567** — ")


def test_churn_bands(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.41,), (0.4,)], "churn_probability double")
    assert [r["band"] for r in sales.churn_bands(df).collect()] == ["high", "medium", "medium", "low"]


def test_lookups(spark):
    churn = spark.createDataFrame(
        [("a", 1, 1, 1.0, 0.9, 1), ("b", 1, 1, 1.0, 0.9, 1), ("c", 1, 1, 1.0, 0.2, 0)],
        "customer_unique_id string, recency int, frequency int, monetary double, churn_probability double, churn_prediction int")
    assert [r[0] for r in sales.top_risk(churn, 5).collect()] == ["a", "b"]
    assert sales.churn_lookup(churn, "nobody").count() == 0
    assert sales.churn_lookup(churn, "c").first()["churn_probability"] == 0.2


def test_insights_are_ten_facts(spark, mart):
    rows = eda.insights(mart.fact_sales, mart.orders, mart.reviews, mart.payments, since=None).collect()
    assert [r["position"] for r in rows] == list(range(1, 11))
    assert rows[0]["value"].endswith(" BRL") and rows[9]["value"] == "0.00%"


@pytest.fixture(scope="module")
def odd_raw(spark):
    """Raw tables with orders, customers and products listed twice, unknown keys, gaps and missing amounts."""
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    items = [("o1", 1, "p1", "10.10"), ("o1", 2, "p2", "5.05"), ("o2", 1, "p1", None), ("o3", 1, "p3", "7.00"),
             ("o4", 1, "p9", "2.50"), ("o5", 1, None, "1.25"), ("o9", 1, "p1", "99.99"), (None, 1, "p2", "3.00"),
             ("o6", 1, "p4", "4.00"), ("o6", 1, "p4", "4.00")]
    return {
        "customers": table(
            [("c1", "u1"), ("c2", "u1"), ("c3", "u2"), ("c3", "u2"), ("c4", None), ("c5", "u3"), ("c5", "u4")],
            "customer_id string, customer_unique_id string").selectExpr("*", "'x' customer_city", "'y' customer_state"),
        "orders": table(
            [("o1", "c1", "2020-01-01 10:00:00"), ("o1", "c2", "2020-01-02 10:00:00"), ("o2", "c2", "no date"),
             ("o3", "c3", "2020-03-01 00:00:00"), ("o4", "c4", "2020-05-01 00:00:00"), ("o5", "c5", "2020-02-01 00:00:00"),
             ("o6", "c8", "2020-04-01 00:00:00"), ("o7", "c1", "2020-09-01 00:00:00"), ("o2", "c5", None)],
            "order_id string, customer_id string, order_purchase_timestamp string"),
        "order_items": table(items, "order_id string, order_item_id int, product_id string, price string").selectExpr(
            "order_id", "order_item_id", "product_id", "'s' seller_id", "cast(price as decimal(12,2)) price",
            "cast(0.5 as decimal(17,4)) freight_value"),
        "products": table(
            [("p1", "a"), ("p1", "b"), ("p2", "a"), ("p3", None), ("p4", "c"), (None, "a"), (None, "b")],
            "product_id string, product_category_name string"),
        "category_translation": table([("a", "A"), ("b", "B")],
                                      "product_category_name string, product_category_name_english string"),
        "payments": table([("o1", "card", 1, "9.00"), ("o1", "slip", 2, "1.00")],
                          "order_id string, payment_type string, payment_installments int, payment_value string")
        .withColumn("payment_value", F.col("payment_value").cast("decimal(12,2)")),
    }


def _sorted_rows(df):
    return sorted(map(repr, df.collect()))


def test_rfm_needs_no_fact_table(odd_raw):
    for repeated in (True, False):
        raw = odd_raw if repeated else odd_raw | {"products": odd_raw["products"].dropDuplicates(["product_id"])}
        m = Mart(raw)
        found = m.rfm
        assert "fact_sales" not in vars(m)
        by_fact = rfm.rfm(m.fact_sales)
        assert dict(found.dtypes) == dict(by_fact.dtypes)
        assert _sorted_rows(found) == _sorted_rows(by_fact) and found.count() == 4


def test_rfm_counts_an_order_once_and_sums_its_rows(odd_raw):
    """Order o1 is two rows with customers of one person; product p1 is listed twice."""
    rows = {r["customer_unique_id"]: r for r in rfm.rfm_of_orders(star.build_customer_orders(
        clean_orders(odd_raw["orders"]), odd_raw["order_items"], odd_raw["products"], odd_raw["customers"])).collect()}
    assert set(rows) == {"u1", "u2", "u3", "u4"}
    assert rows["u1"]["frequency"] == 2 and rows["u1"]["monetary"] == Decimal("53.50")
    assert rows["u1"]["recency"] == 120  # order o4 of an unknown person is the last


def test_recommendations_need_no_fact_table(odd_raw):
    """Product p1 has two categories, o6 and o9 no customer: popularity counts them as the fact table does."""
    m = Mart(odd_raw, min_purchases=1)
    found = {
        "popular": m.popular_products, "items": m.customer_items, "recommendations": m.recommendations,
        "hit_rate": recommend.hit_rate(m.purchases, m.popular_products, n_users=None, items=m.customer_items),
    }
    assert "fact_sales" not in vars(m)
    popular = recommend.popular_products(m.fact_sales, 1)
    by_fact = {
        "popular": popular, "items": recommend.customer_items(m.fact_sales),
        "recommendations": recommend.recommend(m.fact_sales, popular),
        "hit_rate": recommend.hit_rate(m.fact_sales, popular, n_users=None),
    }
    for name, df in by_fact.items():
        assert dict(found[name].dtypes) == dict(df.dtypes), name
        assert _sorted_rows(found[name].select(df.columns)) == _sorted_rows(df), name
    counts = {r["product_id"]: (r["n_purchases"], r["n_customers"]) for r in found["popular"].collect()}
    assert counts["p1"] == (12, 3) and counts["p2"] == (2, 1) and counts["p4"] == (2, 0)


def test_churn_features_need_no_fact_table(spark, odd_raw):
    """Of u1, order o1 is two rows, its product p1 has two categories; o4 of an unknown person is the last order."""
    from storelens.operators import churn

    reviews = spark.createDataFrame([("o1", 5), ("o1", 2), ("o3", 4), (None, 1)], "order_id string, review_score int")
    m = Mart(odd_raw | {"reviews": reviews})
    found = m.raw_features
    assert m.churn_features.count() == 4
    assert "fact_sales" not in vars(m)
    by_fact = churn.churn_features(m.fact_sales, reviews)
    assert dict(found.dtypes) == dict(by_fact.dtypes)
    assert _sorted_rows(found) == _sorted_rows(by_fact)
    rows = {r["customer_unique_id"]: r.asDict() for r in found.collect()}
    u1 = rows["u1"]
    assert [u1[c] for c in ("recency", "frequency", "n_items", "n_products", "n_categories", "n_sellers")] == [
        120, 2, 8, 2, 2, 1]
    assert u1["monetary"] == pytest.approx(53.5) and u1["total_freight"] == pytest.approx(4.0)
    assert (u1["avg_review_score"], u1["n_reviews"], u1["n_payment_methods"], u1["avg_installments"]) == (3.5, 2, 1, 2.0)
    assert rows["u2"]["avg_review_score"] == 4.0 and rows["u3"]["avg_review_score"] == 3.75

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from storelens.operators.star import build_warehouse
from storelens.plans.mart import FIXED_CENTRES, Mart
from storelens.plans.sqlpack import run_pack, run_single
from storelens.session import materialize, shared_dir
from storelens.sources import tables
from storelens.sources.csv import load_raw

CSV = {
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                 "c1,u1,01310,sao paulo,SP\nc2,u2,20040,rio,RJ\n",
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
              "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
              "o1,c1,delivered,2018-01-05 10:00:00,,,2018-01-09 11:00:00,2018-01-20 00:00:00\n"
              "o2,c2,shipped,oops,,,,\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
                   "o1,1,p1,s1,2018-01-07 00:00:00,10.50,2.25\no1,2,p2,s1,2018-01-07 00:00:00,x,1.00\n"
                   "o2,1,p1,s1,2018-01-07 00:00:00,3.00,1.00\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                "o1,1,credit_card,2,13.75\n",
    "reviews": "review_id,order_id,review_score,review_comment_title,review_comment_message\n"
               'r1,o1,5,,"fine,\nreally ""fine"""\nr2,o2,1,,\n',
    "products": "product_category_name,product_id,extra\nmoveis,p1,a\n,p2,b\n",
    "sellers": "seller_id,seller_city,seller_state\ns1,x,SP\n",
    "category_translation": "product_category_name,product_category_name_english\nmoveis,furniture\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_missing_file_is_skipped(spark, folder, caplog):
    raw = load_raw(spark, folder)
    assert set(raw) == set(CSV) and "geolocation" in caplog.text


def test_types_follow_the_names(spark, folder):
    raw = load_raw(spark, folder)
    prices = [r["price"] for r in raw["order_items"].collect()]
    assert prices == [Decimal("10.5000"), None, Decimal("3.0000")]
    first = raw["products"].first()
    assert (first["product_id"], first["product_category_name"], first["extra"]) == ("p1", "moveis", "a")
    assert raw["customers"].first()["customer_zip_code_prefix"] == "01310"


def test_line_breaks_inside_a_review(spark, folder):
    rows = load_raw(spark, folder)["reviews"].collect()
    assert [r["review_score"] for r in rows] == [5, 1]
    assert rows[0]["review_comment_message"] == 'fine,\nreally "fine"'


def test_file_names_can_be_given(spark, folder, tmp_path):
    (tmp_path / "geo.csv").write_text("geolocation_city\nx\n")
    raw = load_raw(spark, folder, {"geolocation": "geo.csv"})
    assert raw["geolocation"].count() == 1


def test_csv_to_stored_warehouse(spark, folder, tmp_path):
    raw = load_raw(spark, folder)
    raw["geolocation"] = raw["sellers"]
    raw["products"] = raw["products"].selectExpr(
        "*", *[f"CAST(NULL AS DOUBLE) AS product_{c}" for c in ("weight_g", "length_cm", "height_cm", "width_cm")])
    out = f"{tmp_path}/warehouse"
    warehouse = build_warehouse(raw)
    tables.save_tables(warehouse, out)
    tables.save_tables(warehouse, out)  # replaces, does not append
    stored = tables.load_tables(spark, out, list(warehouse))
    counts = {r["table_name"]: r["n_rows"] for r in tables.table_inventory(stored).collect()}
    assert counts == {"fact_sales": 3, "dim_customers": 2, "dim_products": 2, "dim_sellers": 1, "orders": 2,
                      "reviews": 2, "payments": 1, "geolocation": 1}
    fact = {(r["order_id"], r["order_item_id"]): r for r in stored["fact_sales"].collect()}
    assert fact["o1", 1]["total_amount"] == Decimal("12.75")
    assert fact["o1", 1]["order_purchase_timestamp"] == dt.datetime(2018, 1, 5, 10)
    assert fact["o1", 1]["product_category_name_english"] == "furniture"
    assert fact["o1", 2]["total_amount"] is None
    assert fact["o2", 1]["year_month"] is None and fact["o2", 1]["payment_value"] is None


def test_partitioned_and_sorted_writes(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, part int")
    tables.save_tables({"t": df, "u": df}, str(tmp_path), partition_by={"t": ["part"]}, sort_by={"u": ["id"]})
    assert (tmp_path / "t" / "part=1").is_dir()
    assert spark.read.parquet(f"{tmp_path}/t").where("part = 1").count() == 5
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/u").collect()] == list(range(10))


def test_preview_checks_the_name(spark):
    tables.register({"some_table": spark.range(500)})
    assert tables.preview(spark, "some_table", 7).count() == 7
    with pytest.raises(ValueError):
        tables.preview(spark, "some_table; DROP TABLE x")


def test_pack_goes_on_after_an_error(spark):
    tables.register({"numbers": spark.range(10)})
    pack = {"good": "SELECT count(*) AS n FROM numbers WHERE id >= :low",
            "no_table": "SELECT * FROM nowhere",
            "runtime": "SELECT 1 / (id - id) AS x FROM numbers",
            "last": "SELECT id FROM numbers ORDER BY id LIMIT :low"}
    out = run_pack(spark, pack, {"low": 4}, run=True)
    assert out["good"].first()["n"] == 6
    assert "nowhere" in out["no_table"]
    assert "DIVIDE_BY_ZERO" in out["runtime"]
    assert [r["id"] for r in out["last"].collect()] == [0, 1, 2, 3]
    assert run_single(spark, "SELECT :who AS who", {"who": "x' OR '1'='1"}).first()["who"] == "x' OR '1'='1"


def test_materialized_rows_are_the_same(spark):
    df = spark.range(100).selectExpr("id", "id % 3 AS k")
    again = materialize(df, "test")
    assert again.schema.fieldNames() == ["id", "k"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert again.inputFiles()[0].split("/storelens/")[0].endswith(shared_dir(spark).split(":")[-1].rstrip("/"))


def test_mart_save(spark, mart, tmp_path):
    out = str(tmp_path)
    small = Mart(mart.raw, min_purchases=30, centres=FIXED_CENTRES)
    for name in ("orders", "fact_sales", "rfm", "rfm_scores", "customer_segments", "popular_products", "recommendations"):
        small.__dict__[name] = getattr(mart, name)
    small.save(out)
    segments = spark.read.parquet(f"{out}/customer_segments")
    assert segments.count() == mart.rfm.count()
    assert spark.read.parquet(f"{out}/recommendations").groupBy("customer_unique_id").count().agg({"count": "max"}).first()[0] <= 5
    for artifact in ("customer_products", "customer_categories", "top_per_category", "popular_products"):
        assert spark.read.parquet(f"{out}/artifacts/{artifact}").count() > 0


def test_close_removes_what_was_written(spark, tmp_path, monkeypatch):
    from storelens import session

    monkeypatch.setattr(session, "_application_dir", lambda _: str(tmp_path / "app"))
    assert materialize(spark.range(5), "gone").count() == 5
    assert list(tmp_path.glob("app/gone-*"))
    session.close(spark)
    assert not list(tmp_path.iterdir())


def test_explorer_lists_whatever_is_stored(spark, tmp_path):
    tables.save_tables({"orders": spark.range(3).toDF("order_id"), "extra": spark.range(2)}, str(tmp_path))
    found = tables.load_all(spark, str(tmp_path))
    assert {n: df.count() for n, df in found.items()} == {"orders": 3, "extra": 2}


COLUMNS = ["review_id", "order_id", "review_score", "review_comment_title", "review_comment_message"]


def _write_reviews(path, n, first, order, line_end):
    import csv
    import random

    rng = random.Random(first)
    texts = ["fine", 'a "quoted" word', "line\nbreak", "many\n\nbreaks, and commas\n", "", 'é,ü\n"x"\ny' * 60]
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator=line_end)
        out.writerow(order)
        for i in range(n):
            row = dict(zip(COLUMNS, (f"r{first + i}", f"o{i}", rng.randrange(1, 6), "", rng.choice(texts))))
            out.writerow([row[c] for c in order])


def test_quoted_files_are_cut_among_tasks(spark, tmp_path):
    parts = tmp_path / "reviews.csv"
    parts.mkdir()
    orders = [COLUMNS, COLUMNS, COLUMNS[::-1]]
    for k, order in enumerate(orders):
        _write_reviews(parts / f"part-{k}.csv", 400, 1000 * k, order, "\n" if k else "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = spark.read.text(str(parts))
        assert lines.rdd.getNumPartitions() > 10
        found = load_raw(spark, str(tmp_path))["reviews"].select(COLUMNS).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    wanted = []
    for k, order in enumerate(orders):
        schema = ", ".join(f"{c} {'int' if c == 'review_score' else 'string'}" for c in order)
        wanted += spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(
            str(parts / f"part-{k}.csv")).select(COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, wanted), key=str)
    assert len(found) == 1200


def test_parts_are_read_by_their_own_header(spark, tmp_path):
    parts = tmp_path / "sellers.csv"
    parts.mkdir()
    (parts / "a.csv").write_text("seller_id,seller_city,seller_state\ns1,x,SP\n", encoding="utf-8")
    (parts / "b.csv").write_text("\ufeffseller_state,seller_id,more\nRJ,s2,1\n", encoding="utf-8")
    (parts / "_SUCCESS").write_text("")
    found = load_raw(spark, str(tmp_path))["sellers"].select("seller_id", "seller_city", "seller_state", "more").collect()
    assert sorted(map(tuple, found)) == [("s1", "x", "SP", None), ("s2", None, "RJ", "1")]


def test_same_rows_by_content(spark):
    from storelens.sources.tables import content, same_rows

    kinds = "a long, b string, c double"
    rows = [(1, "x", 0.5), (None, "x", 0.5), (1, None, None), (2, "y", 1.5), (2, "y", 1.5)]
    df = spark.createDataFrame(rows, kinds)
    assert same_rows(df, df.repartition(5).select("c", "a", "b"))
    for other in (rows[:-1], [*rows[:-1], rows[0]], [*rows[:-1], (2, "y", 1.25)], [*rows, rows[0]],
                  [*rows[:2], (None, "1", None), *rows[3:]], [*rows[:1], (1, "x", None), *rows[2:]]):
        assert not same_rows(df, spark.createDataFrame(other, kinds))
    assert not same_rows(df, df.withColumn("a", df["a"].cast("int")))
    plan = content(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # rows stay where they are


def test_written_csv_parts_grow_with_the_rows(spark, sf, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "CSV_ROWS", 500)
    monkeypatch.setattr(entry, "scratch", lambda *_: str(tmp_path))
    assert all(r["same"] for r in entry._csv_roundtrip(spark, sf).collect())
    assert len(list((tmp_path / "orders.csv").glob("part-*"))) == 4  # 1,500 rows
    assert len(list((tmp_path / "sellers.csv").glob("part-*"))) == 3


def test_shuffles_begin_with_partitions_for_the_input(spark, sf, monkeypatch):
    from storelens import session
    from storelens.sources import surrogate

    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    raw = surrogate.raw_tables(spark, sf)
    before = spark.conf.get(first, None)
    try:
        session.fit_shuffles(spark, raw.values())
        assert spark.conf.get(first, None) == before  # small input
        monkeypatch.setattr(session, "INPUT_A_PARTITION", 4096)
        session.fit_shuffles(spark, raw.values())
        assert int(spark.conf.get(first)) > 20 and spark.conf.get(size) == "8m"
    finally:
        spark.conf.unset(first)
        spark.conf.unset(size)

"""Ranks, running totals, quantiles and salted joins against plain Python on small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.functions import skew
from storelens.functions.binning import histogram, kde
from storelens.functions.quantiles import exact_quantiles
from storelens.functions.ranking import global_rank, running_totals
from storelens.functions.sampling import hash_sample


def test_global_rank(spark):
    rows = [(random.Random(i).randrange(5), f"id{i:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "f int, id string").repartition(7)
    found = {r["id"]: r["rank"] for r in global_rank(df, ["f", "id"], "rank").collect()}
    assert found == {row[1]: i for i, row in enumerate(sorted(rows), 1)}


def test_global_rank_of_nothing(spark):
    df = spark.createDataFrame([], "f int, id string")
    assert global_rank(df, ["f", "id"], "rank").count() == 0


def test_running_totals(spark):
    rows = [(i, random.Random(i).randrange(100)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    found = {r["k"]: r["upto"] for r in running_totals(df, [F.desc("k")], {"upto": "v"}).collect()}
    total, expected = 0, {}
    for k, v in sorted(rows, reverse=True):
        total += v
        expected[k] = total
    assert found == expected


@pytest.mark.parametrize("n", [1, 2, 5, 6, 1001])
def test_exact_quantiles(spark, n):
    source = random.Random(n)
    a = [source.choice([1.0, 1.0, 1.0, source.random() * 100]) for _ in range(n)]
    b = [source.randrange(50) for _ in range(n)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b int")
    for row in exact_quantiles(df, ["a", "b"]).collect():
        values = a if row["column"] == "a" else b
        expected = np.quantile(values, [0.25, 0.5, 0.75])
        assert row["n"] == n
        assert [row["q0"], row["q1"], row["q2"]] == pytest.approx(list(expected), rel=1e-12)


def test_exact_quantiles_by_group_without_nulls(spark):
    rows = [("x", float(i)) for i in range(10)] + [("y", 3.0), ("y", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: (r["n"], r["q0"]) for r in exact_quantiles(df, ["v"], (0.5,), by="g").collect()
             if r["g"] is not None}
    assert found == {"x": (10, 4.5), "y": (1, 3.0)}


def test_hot_keys_finds_a_third_and_nulls(spark):
    rows = [("hot",)] * 4000 + [(None,)] * 3000 + [(f"k{i}",) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string").repartition(6)
    found = dict(skew.hot_keys(df, "k", 0.01))
    assert set(found) == {"hot", None}
    assert found["hot"] >= 33 and found[None] >= 24


def test_no_hot_keys_in_even_data(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("k"))
    assert skew.hot_keys(df, "k") == []


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_equals_plain_join(spark, how):
    left = [("hot", i) for i in range(3000)] + [(None, i) for i in range(2000)]
    left += [(f"k{i}", i) for i in range(4000)]
    right = [("hot", "h1"), ("hot", "h2")] + [(f"k{i}", str(i)) for i in range(0, 4000, 2)]
    a = spark.createDataFrame(left, "k string, v int").repartition(5)
    b = spark.createDataFrame(right, "k string, w string")
    salted = skew.left_join(skew.spread_rows(a), b, "k", how, known_large=True).drop("_spread")
    unnumbered = skew.left_join(a, b, "k", how, known_large=True)
    plain = a.join(b, "k", how)

    def rows(df):
        return sorted(map(str, df.select(*plain.columns).collect()))

    assert "_salt" in salted._jdf.queryExecution().toString()
    assert rows(salted) == rows(plain) == rows(unnumbered)


def test_salted_join_spreads_copies_of_one_row(spark):
    a = spark.createDataFrame([("hot", 1)] * 6000 + [(f"k{i}", 1) for i in range(6000)], "k string, v int")
    b = spark.createDataFrame([("hot", "w")], "k string, w string")
    hot = skew.hot_keys(a, "k")
    joined = skew._salted(skew.spread_rows(a), b, "k", "left", hot)
    per_salt = (
        a.transform(skew.spread_rows).where("k = 'hot'")
        .groupBy((F.col("_spread") % hot[0][1]).alias("s")).count()
    )
    assert per_salt.agg(F.max("count")).first()[0] < 6000 / 50
    assert joined.where("w = 'w'").count() == 6000


def test_histogram(spark):
    values = [0.0, 0.1, 0.5, 0.99, 1.0, 2.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    out = histogram(df, "v", 4).collect()
    counts, edges = np.histogram(values, bins=4)
    assert [r["n"] for r in out] == list(counts)
    assert [r["lo"] for r in out] + [out[-1]["hi"]] == pytest.approx(list(edges))


def test_histogram_of_one_value(spark):
    out = histogram(spark.createDataFrame([(3.0,)] * 5, "v double"), "v", 2).collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in out] == [(2.5, 3.0, 0), (3.0, 3.5, 5)]


def test_grouped_histogram_has_area_one(spark):
    rows = [(g, random.Random(g * 100 + i).random()) for g in (0, 1) for i in range(200)]
    out = histogram(spark.createDataFrame(rows, "g int, v double"), "v", 10, "g")
    areas = out.groupBy("g").agg(F.sum(F.col("density") * (F.col("hi") - F.col("lo"))).alias("a"))
    assert [r["a"] for r in areas.collect()] == pytest.approx([1.0, 1.0])


def test_kde(spark):
    values = [random.Random(i).gauss(10, 3) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    h = np.std(values, ddof=1) * len(values) ** -0.2
    xs = np.linspace(min(values), max(values), 200)
    expected = [np.mean(np.exp(-0.5 * ((x - np.array(values)) / h) ** 2)) / (h * np.sqrt(2 * np.pi)) for x in xs]
    out = kde(df, "v").collect()
    assert [r["density"] for r in out] == pytest.approx(expected)
    assert kde(df.where("v IS NULL"), "v").collect() == []
    one = kde(df.limit(1), "v").collect()
    assert len(one) == 200 and one[0]["density"] is None


def test_hash_sample(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    first = hash_sample(df, ["id"], 20).collect()
    again = hash_sample(df.repartition(9), ["id"], 20).collect()
    assert first == again and len(first) == 20
    assert hash_sample(df.limit(5), ["id"], 20).count() == 5


def test_small_means_few_rows_and_few_bytes(spark):
    df = spark.createDataFrame([("x" * 100, i, [1, 2]) for i in range(10)], "t string, n int, a array<int>")
    assert skew.is_small(df)
    assert not skew.is_small(df, max_rows=9)
    assert not skew.is_small(df, max_bytes=1000)
    assert skew.is_small(df.where("n < 0"), max_rows=0, max_bytes=0)


def test_quantiles_of_many_groups_with_a_hot_one(spark, monkeypatch):
    from storelens.functions import quantiles

    monkeypatch.setattr(quantiles, "is_small", lambda df: False)
    rows = [(f"g{i % 300}", float(i)) for i in range(900)] + [("hot", float(i % 97)) for i in range(600)]
    df = spark.createDataFrame(rows + [(None, 3.0), (None, 4.0)], "g string, v double")
    found = {r["g"]: (r["n"], r["q0"]) for r in exact_quantiles(df, ["v"], (0.5,), by="g").collect()}
    assert found["hot"] == (600, float(np.median([i % 97 for i in range(600)])))
    assert found["g7"] == (3, 307.0) and len(found) >= 301

"""The uniform shuffle: exact sizes, the distribution of its draws, odd input."""

from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from storelens.llm import sharding


def quantile(total, good, drawn, u):
    """The least count whose share of all draws, with those below, is over u."""
    below = Fraction(0)
    for k in range(max(0, drawn - (total - good)), min(drawn, good) + 1):
        below += Fraction(math.comb(good, k) * math.comb(total - good, drawn - k), math.comb(total, drawn))
        if below > u:
            return k
    raise AssertionError("u is beyond all counts")


def test_draws_are_hypergeometric(spark):
    cases = [(t, g, d) for t in (1, 2, 5, 40, 3000) for g in {0, 1, t // 3, t - 1, t} for d in {0, 1, t // 2, t}]
    cases += [(50_000, 25_000, 20_000), (10**6, 3, 500_000), (10**6, 999_990, 1000)]
    points = [0.0, 0.011, 0.27, 0.5003, 0.7501, 0.98, 1 - 2**-40]
    rows = [(*c, u) for c in cases for u in points if (c[0] <= 10**5 or c[1] < 100) and (u or c[0] < 100)]
    df = spark.createDataFrame(rows, "total long, good long, drawn long, u double")
    found = df.select("*", sharding.hypergeometric(*map(F.col, ("total", "good", "drawn", "u"))).alias("k")).collect()
    for r in found:
        assert r["k"] == quantile(r["total"], r["good"], r["drawn"], Fraction(r["u"])), r


def test_large_draws_keep_mean_and_deviation(spark):
    n, k, d = 10**10, 2 * 10**9, 3 * 10**5
    df = spark.range(400).select(
        sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(d), (F.col("id") + 0.5) / 400).alias("k"))
    mean, deviation = df.agg(F.avg("k"), F.stddev("k")).first()
    p = k / n
    assert abs(mean - d * p) < 2
    assert abs(deviation / math.sqrt(d * p * (1 - p) * (n - d) / (n - 1)) - 1) < 0.02


@pytest.mark.parametrize("fan", [64, 3])
def test_matrix_has_its_margins(spark, monkeypatch, fan):
    monkeypatch.setattr(sharding, "FAN", fan)
    parts = {i: (i * 7) % 23 + (500 if i == 11 else 0) for i in range(0, 70) if i % 13}
    parts = {i: n for i, n in parts.items() if n}
    df = spark.createDataFrame(list(parts.items()), "node long, n long")
    sizes = sharding.shard_sizes(sum(parts.values()), 5)
    rows = sharding.communication_matrix(df, sizes, 3).collect()
    assert {r["node"]: sum(r["counts"]) for r in rows} == parts
    assert [sum(r["counts"][j] for r in rows) for j in range(5)] == sizes
    assert all(min(r["counts"]) >= 0 for r in rows)
    again = {r["node"]: r["counts"] for r in sharding.communication_matrix(df, sizes, 3).collect()}
    assert again == {r["node"]: r["counts"] for r in rows}


def test_counts_spread_as_a_uniform_shuffle(spark):
    """The squared misses of 600 partitions of 20 rows are what the hypergeometric variance gives."""
    df = spark.range(600).select(F.col("id").alias("node"), F.lit(20).cast("long").alias("n"))
    rows = sharding.communication_matrix(df, sharding.shard_sizes(12_000, 4), 1).collect()
    for j in range(4):
        found = sum((r["counts"][j] - 5) ** 2 for r in rows) / 600
        assert abs(found / (20 * 0.25 * 0.75) - 1) < 0.2


def test_shuffle_is_exact_and_whole(spark, monkeypatch, make_docs, odd_rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    rows = odd_rows + [(i, f"text {i}") for i in range(100, 900)] + [(None, "same")] * 500
    docs = make_docs(rows).withColumns({"shard": F.lit("s"), "slot": F.lit("t"), "_at": F.lit(0)}).repartition(5)
    out = sharding.shuffled(docs, 7, seed=4)
    found = out.select("_row.doc_id", "_row.text", "shard", "slot").collect()
    assert Counter((r[0], r[1]) for r in found) == Counter(r[:2] for r in rows)
    sizes = Counter(r["shard"] for r in found)
    assert [sizes[j] for j in range(7)] == sharding.shard_sizes(len(rows), 7)
    for j in range(7):
        assert sorted(r["slot"] for r in found if r["shard"] == j) == list(range(sizes[j]))
    # neither shards nor slots follow the ids
    at = sorted((r["doc_id"], r["shard"], r["slot"]) for r in found if r["doc_id"] and r["doc_id"] >= 100)
    low = [a for a in at[:400]]
    assert 25 < Counter(a[1] for a in low)[3] < 95
    assert abs(sum(a[2] for a in low) / 400 / (len(rows) / 14) - 1) < 0.15


def test_same_files_same_shuffle(spark, tmp_path, make_docs):
    make_docs([(i, f"text {i}") for i in range(300)]).repartition(3).write.parquet(f"{tmp_path}/docs")
    runs = [{tuple(r) for r in sharding.shuffled(spark.read.parquet(f"{tmp_path}/docs"), 8, seed).select(
        "_row.doc_id", "shard", "slot").collect()} for seed in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]


def test_few_rows_and_files(spark, tmp_path, make_docs):
    docs = make_docs([(1, "a"), (2, "b"), (3, None)])
    assert sorted(r["shard"] for r in sharding.shuffled(docs, 8).collect()) == [0, 1, 2]
    assert sharding.shuffled(docs.where("doc_id > 9"), 8).collect() == []
    sharding.write_shards(docs, f"{tmp_path}/shards", 2)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(r["doc_id"] for r in back.select("_row.*").collect()) == [1, 2, 3]
    assert Counter(r["shard"] for r in back.collect()) == {0: 2, 1: 1}
    with pytest.raises(ValueError):
        sharding.shuffled(docs, 0)

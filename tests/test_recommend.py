"""Recommendations against the plain per-customer loop they stand for."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from storelens.operators import recommend as R


def purchases(seed, customers=25, products=40, rows=220, hot=0.35):
    source = random.Random(seed)
    out = []
    for i in range(rows):
        customer = "c00" if source.random() < hot else f"c{source.randrange(customers):02d}"
        product = min(source.randrange(products), source.randrange(products))
        category = None if product % 11 == 10 else f"cat{product % 6}"
        out.append({"order_id": f"o{i // 2}", "customer_unique_id": customer, "product_id": f"p{product:02d}",
                    "product_category_name_english": category})
    out.append({"order_id": "x", "customer_unique_id": None, "product_id": "p01",
                "product_category_name_english": "cat1"})
    return out


def plain_popular(rows, min_purchases):
    count, who, category = Counter(), defaultdict(set), {}
    for r in rows:
        count[r["product_id"]] += 1
        if r["customer_unique_id"]:
            who[r["product_id"]].add(r["customer_unique_id"])
        category[r["product_id"]] = r["product_category_name_english"]
    kept = [p for p in count if count[p] >= min_purchases]
    kept.sort(key=lambda p: (-len(who[p]), -count[p], p))
    return [(p, category[p]) for p in kept]


def plain_recommend(rows, popular, n, per_category, bought=None):
    mine, favourites = defaultdict(set), defaultdict(Counter)
    for r in rows:
        if r["customer_unique_id"]:
            mine[r["customer_unique_id"]].add(r["product_id"])
            if r["product_category_name_english"]:
                favourites[r["customer_unique_id"]][r["product_category_name_english"]] += 1
    lists = defaultdict(list)
    for p, c in popular:
        if c and len(lists[c]) < per_category:
            lists[c].append(p)
    out = {}
    for customer, products in mine.items():
        owned = products if bought is None else bought[customer]
        liked = sorted(favourites[customer].items(), key=lambda x: (-x[1], x[0]))
        picks = [p for c, _ in liked for p in lists[c] if p not in owned]
        if len(picks) < n:
            picks += [p for p, _ in popular if p not in owned and p not in picks]
        out[customer] = picks[:n]
    return out


def as_lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["customer_unique_id"], r["rank"])):
        out[r["customer_unique_id"]].append(r["product_id"])
        assert r["rank"] == len(out[r["customer_unique_id"]]) and r["score"] == 10 - r["rank"]
    return dict(out)


@pytest.mark.parametrize(
    "seed,n,per_category", [(1, 5, 20), (2, 5, 2), (3, 12, 1), (4, 30, 3), (5, 1, 1), (6, 100, 20)]
)
def test_every_customer_gets_what_the_loop_gives(make_fact, seed, n, per_category):
    rows = purchases(seed)
    fact = make_fact(rows).repartition(3)
    popular = plain_popular(rows, 3)
    table = R.popular_products(fact, 3)
    ranked = sorted(table.collect(), key=lambda r: r["popularity_rank"])
    assert [(r["product_id"], r["category"]) for r in ranked] == popular
    expected = {c: p for c, p in plain_recommend(rows, popular, n, per_category).items() if p}
    assert as_lists(R.recommend(fact, table, n, per_category)) == expected


def test_fill_reaches_beyond_the_broadcast_head(make_fact, monkeypatch):
    monkeypatch.setattr(R, "HEAD_ROWS", 4)
    monkeypatch.setattr(R, "_BLOCK", 3)
    rows = purchases(7)
    fact = make_fact(rows)
    popular = plain_popular(rows, 2)
    expected = plain_recommend(rows, popular, 20, 1)
    assert as_lists(R.recommend(fact, R.popular_products(fact, 2), 20, 1)) == expected


def test_salted_category_join_gives_the_same(make_fact, monkeypatch):
    from storelens.functions import skew

    rows = purchases(8)
    fact = make_fact(rows)
    popular = R.popular_products(fact, 2)
    expected = as_lists(R.recommend(fact, popular, 5))
    monkeypatch.setattr(skew, "HOT_SHARE", 0.1)
    monkeypatch.setattr(skew, "is_small", lambda df, *bounds: False)
    assert as_lists(R.recommend(fact, popular, 5)) == expected


def test_bought_override(spark, make_fact):
    rows = purchases(9)
    fact = make_fact(rows)
    none = spark.createDataFrame([], "customer_unique_id string, product_id string")
    popular = plain_popular(rows, 2)
    expected = plain_recommend(rows, popular, 5, 20, bought=defaultdict(set))
    assert as_lists(R.recommend(fact, R.popular_products(fact, 2), 5, bought=none)) == expected


def test_hit_rate(make_fact):
    rows = purchases(10)
    fact = make_fact(rows)
    popular = R.popular_products(fact, 3)
    row = R.hit_rate(fact, popular, k=10, n_users=None).first()
    mine = defaultdict(set)
    for r in rows:
        mine[r["customer_unique_id"]].add(r["product_id"])
    assert row["n_evaluated"] == sum(1 for c, p in mine.items() if c and len(p) >= 2)
    assert 0 <= row["hit_rate"] <= 1
    assert row["random_baseline"] == pytest.approx(100 / 6)
    leak_free = R.hit_rate(fact, popular, k=10, n_users=None, leak_free=True).first()
    assert leak_free["hit_rate"] <= row["hit_rate"]
    few = R.hit_rate(fact, popular, k=10, n_users=5).first()
    assert few["n_evaluated"] <= 5


def test_hit_rate_of_single_purchases_is_zero(make_fact):
    fact = make_fact([{"order_id": "o", "customer_unique_id": "c", "product_id": "p",
                       "product_category_name_english": "x"}])
    row = R.hit_rate(fact, R.popular_products(fact, 1), n_users=None).first()
    assert (row["hit_rate"], row["n_evaluated"]) == (0.0, 0)


def test_lookup_falls_back_for_strangers(spark, make_fact):
    rows = purchases(11)
    fact = make_fact(rows)
    popular = R.popular_products(fact, 2)
    recos = R.recommend(fact, popular, 5)
    ids = spark.createDataFrame([("c00",), ("c00",), ("nobody",)], "customer_unique_id string")
    out = R.reco_lookup(ids, recos, popular, 3).collect()
    known = [r for r in out if r["customer_unique_id"] == "c00"]
    stranger = sorted((r for r in out if r["customer_unique_id"] == "nobody"), key=lambda r: r["rank"])
    assert sorted(r["rank"] for r in known) == [1, 2, 3] and not any(r["fallback"] for r in known)
    assert [r["product_id"] for r in stranger] == [p for p, _ in plain_popular(rows, 2)[:3]]
    assert all(r["fallback"] and r["score"] is None for r in stranger)


def test_history_and_categories(make_fact):
    rows = purchases(12)
    fact = make_fact(rows)
    history = {r[0]: tuple(r)[1:] for r in R.customer_history(fact).collect()}
    for customer in {r["customer_unique_id"] for r in rows if r["customer_unique_id"]}:
        own = [r for r in rows if r["customer_unique_id"] == customer]
        assert history[customer] == tuple(
            len({r[c] for r in own} - {None})
            for c in ("order_id", "product_id", "product_category_name_english"))
    assert {r["category"] for r in R.category_stats(fact).collect()} == {f"cat{i}" for i in range(6)}


def test_categories_are_sorted_without_their_lists(spark):
    favourites = spark.createDataFrame([("c", "k", 1)], "customer_unique_id string, category string, fav_rank int")
    lists = spark.createDataFrame([("k", 7, 1), ("k", 8, 2)], "category string, product_id long, cat_rank int")
    bought = spark.createDataFrame([("c", 7)], "customer_unique_id string, product_id long")
    found = R._from_favourites(favourites, lists, bought, 1)
    assert sorted(r["product_id"] for r in found.collect()) == [7, 8]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "Window" in line)
    below = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
    assert "_list" not in "".join(lines[at:below])

"""Product popularity and hybrid recommendations for every customer at once.

A customer gets the best products of their favourite categories in order, minus
what they bought, then the most popular products overall. Candidates are never
customers times products: among the first n + b candidates at most b (the number
of products bought) can drop out, so no more than that many are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.columns import hash_number
from storelens.functions.ranking import global_rank
from storelens.functions.sampling import hash_sample
from storelens.functions.skew import left_join
from storelens.session import materialize

MIN_PURCHASES = 10
PER_CATEGORY = 20
HEAD_ROWS = 10_000  # best-ranked products that are sent to every task when filling up
_BLOCK = 1024

_CUSTOMER = "customer_unique_id"
_CATEGORY = "product_category_name_english"


def _category() -> Column:
    return F.col("product_category_name_english").alias("category")


def _reco() -> list[Column | str]:
    return [_CUSTOMER, "product_id", "rank", (10.0 - F.col("rank")).alias("score")]


def popular_products(fact: DataFrame, min_purchases: int = MIN_PURCHASES) -> DataFrame:
    """Products with enough purchases, ranked by customers, purchases, id."""
    stats = (
        fact.where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(
            F.count("order_id").alias("n_purchases"),
            F.countDistinct(_CUSTOMER).alias("n_customers"),
            F.min("product_category_name_english").alias("category"),
        )
        .where(F.col("n_purchases") >= min_purchases)
    )
    return _by_popularity(stats)


def _by_popularity(stats: DataFrame) -> DataFrame:
    order = [F.desc("n_customers"), F.desc("n_purchases"), F.asc("product_id")]
    return global_rank(stats, order, "popularity_rank", "popularity")


def popular_of_purchases(purchases: DataFrame, min_purchases: int = MIN_PURCHASES) -> DataFrame:
    """popular_products from the rows of grouped_purchases.

    Of one product and category each customer has one row, so rows are counted; only if a product has two
    categories are its customers told apart.
    """
    sold = purchases.where(F.col("product_id").isNotNull())
    by_kind = materialize(
        sold.groupBy("product_id", _CATEGORY).agg(
            F.sum("_orders").alias("n_purchases"), F.count(_CUSTOMER).alias("n_customers")
        ),
        "product-counts",
    )
    stats = by_kind.groupBy("product_id").agg(
        F.sum("n_purchases").alias("n_purchases"),
        F.sum("n_customers").alias("n_customers"),
        F.min(_CATEGORY).alias("category"),
        F.count(F.lit(1)).alias("_kinds"),
    )
    several = stats.where("_kinds > 1").select("product_id")
    stats = stats.drop("_kinds")
    if not several.isEmpty():
        exact = (
            left_join(sold, several, "product_id", "left_semi")
            .groupBy("product_id")
            .agg(F.countDistinct(_CUSTOMER).alias("_exact"))
        )
        stats = stats.join(exact, "product_id", "left").select(
            "product_id", "n_purchases", F.coalesce("_exact", "n_customers").alias("n_customers"), "category"
        )
    return _by_popularity(stats.where(F.col("n_purchases") >= min_purchases))


def category_stats(fact: DataFrame) -> DataFrame:
    """Purchases and customers per category, most customers first."""
    return (
        fact.where(F.col("product_category_name_english").isNotNull())
        .groupBy(_category())
        .agg(
            F.count("order_id").alias("n_purchases"),
            F.countDistinct(_CUSTOMER).alias("n_customers"),
        )
        .orderBy(F.desc("n_customers"), "category")
    )


def customer_history(fact: DataFrame) -> DataFrame:
    """Distinct orders, products and categories per customer."""
    kinds = (
        fact.where(F.col(_CUSTOMER).isNotNull())
        .select(_CUSTOMER, "order_id", "product_id", "product_category_name_english").distinct()
    )
    return kinds.groupBy(_CUSTOMER).agg(
        F.countDistinct("order_id").alias("n_orders"),
        F.countDistinct("product_id").alias("n_products"),
        F.countDistinct("product_category_name_english").alias("n_categories"),
    )


def bought_products(fact: DataFrame) -> DataFrame:
    """Distinct (customer, product) pairs."""
    return (
        fact.where(F.col(_CUSTOMER).isNotNull() & F.col("product_id").isNotNull())
        .select(_CUSTOMER, "product_id")
        .distinct()
    )


def _ranked_categories(counts: DataFrame) -> DataFrame:
    """(customer, category, _n) as favourites: most items first, ties by name."""
    order = Window.partitionBy(_CUSTOMER).orderBy(F.desc("_n"), "category")
    return counts.select(_CUSTOMER, "category", F.row_number().over(order).alias("fav_rank"))


def favourite_categories(fact: DataFrame) -> DataFrame:
    """Categories of each customer by number of items, ties by name."""
    return _ranked_categories(
        fact.where(
            F.col(_CUSTOMER).isNotNull() & F.col("product_category_name_english").isNotNull()
        )
        .groupBy(_CUSTOMER, _category())
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def top_per_category(popular: DataFrame, n: int = PER_CATEGORY) -> DataFrame:
    """The n most popular products of each category."""
    order = Window.partitionBy("category").orderBy("popularity_rank")
    return (
        popular.where(F.col("category").isNotNull())
        .withColumn("cat_rank", F.row_number().over(order))
        .where(F.col("cat_rank") <= n)
        .select("category", "product_id", "cat_rank")
    )


def grouped_purchases(fact: DataFrame) -> DataFrame:
    """Items (_n) and those of known orders (_orders) per customer, product and category.

    The one pass over the fact table: all that follows works on this written table.
    Rows without a customer stay, since they count for a product.
    """
    return materialize(
        fact.groupBy(_CUSTOMER, "product_id", _CATEGORY).agg(
            F.count(F.lit(1)).alias("_n"), F.count("order_id").alias("_orders")
        ),
        "purchases",
    )


def known_items(purchases: DataFrame) -> DataFrame:
    """customer_items from the rows of grouped_purchases."""
    return purchases.where(F.col(_CUSTOMER).isNotNull()).select(_CUSTOMER, "product_id", _category(), "_n")


def customer_items(fact: DataFrame) -> DataFrame:
    """Items per customer, product and category; several calls can share one."""
    return known_items(grouped_purchases(fact))


def _favourites(items: DataFrame) -> DataFrame:
    return _ranked_categories(
        items.where(F.col("category").isNotNull())
        .groupBy(_CUSTOMER, "category")
        .agg(F.sum("_n").alias("_n"))
    )


def _bought(items: DataFrame) -> DataFrame:
    """(customer, product) pairs; a pair may occur twice if a product has two categories."""
    return items.where(F.col("product_id").isNotNull()).select(_CUSTOMER, "product_id")


def _only(pairs: DataFrame, keep: DataFrame, key: str, label: str) -> DataFrame:
    """The pairs whose key occurs in `keep`, written because they are read twice."""
    return materialize(left_join(pairs, keep.select(key), key, "left_semi"), label)


def _pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(_CUSTOMER).agg(F.count(F.lit(1)).alias("_b"))


def _from_favourites(
    favourites: DataFrame, lists: DataFrame, bought: DataFrame, n: int
) -> DataFrame:
    """The first n + b products of the customer's own list, with their position.

    b counts what the customer bought among the listed products, so after taking
    those out n are left, or the list has no more.
    """
    by_category = lists.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("cat_rank", "product_id"))).alias("_list")
    )
    sizes = lists.groupBy("category").agg(F.count(F.lit(1)).alias("_size"))
    own = left_join(favourites, sizes, "category", "inner").join(
        _pair_counts(bought), _CUSTOMER, "left"
    )
    earlier = (
        Window.partitionBy(_CUSTOMER)
        .orderBy("fav_rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # the lists join what is left of the categories: sorting a customer's categories with them took twenty times the memory
    reached = (
        own.withColumn("_reach", F.coalesce("_b", F.lit(0)) + n)
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .where(F.col("_before") < F.col("_reach"))
        .select(_CUSTOMER, "category", "_before", "_reach")
    )
    return (
        left_join(reached, by_category, "category", "inner")
        .select(_CUSTOMER, "category", "_before", "_reach", F.inline("_list"))
        .withColumn("_position", F.col("_before") + F.col("cat_rank"))
        .where(F.col("_position") <= F.col("_reach"))
        .select(_CUSTOMER, "product_id", "category", "_position")
    )


def _from_popular(short: DataFrame, bought: DataFrame, popular: DataFrame, n: int) -> DataFrame:
    """The first n + b popular products for each customer that is short of n.

    b counts the popular products the customer bought. Of n + b products at most
    b were bought and the customer's own candidates are part of the n, so n
    remain. Ranks are unrolled in blocks and matched by equality; every short
    customer asks for the best ranks, so those are broadcast.
    """
    listed = popular.select("popularity_rank", "product_id", "category")
    most = popular.agg(F.count(F.lit(1))).scalar()
    reach = F.least(F.coalesce("_b", F.lit(0)) + n, most)
    wanted = short.join(_pair_counts(bought), _CUSTOMER, "left").select(
        _CUSTOMER, reach.alias("_reach")
    )
    last_block = F.floor((F.col("_reach") - 1) / _BLOCK)
    first = F.col("_block") * _BLOCK + 1
    last = F.least(F.col("_reach"), (F.col("_block") + 1) * _BLOCK)
    ranks = (
        wanted.where("_reach > 0")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
        .withColumn("popularity_rank", F.explode(F.sequence(first, last)))
        .select(_CUSTOMER, "popularity_rank")
    )
    head = F.broadcast(listed.where(F.col("popularity_rank") <= HEAD_ROWS))  # ranks are unique
    out = ranks.where(F.col("popularity_rank") <= HEAD_ROWS).join(head, "popularity_rank")
    if popular.count() > HEAD_ROWS:
        rest = listed.where(F.col("popularity_rank") > HEAD_ROWS)
        out = out.unionByName(
            ranks.where(F.col("popularity_rank") > HEAD_ROWS).join(rest, "popularity_rank")
        )
    return out.select(_CUSTOMER, "product_id", "category", "popularity_rank")


def _recommend(
    customers: DataFrame,
    favourites: DataFrame,
    bought: DataFrame,
    popular: DataFrame,
    n: int,
    per_category: int,
) -> DataFrame:
    """The first n of favourites, then popular, for each of the distinct customers."""
    pair = [_CUSTOMER, "product_id"]
    best = Window.partitionBy(_CUSTOMER).orderBy("_source", "_position")

    def first_n(candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)

    lists = top_per_category(popular, per_category)
    known = _only(bought, lists, "product_id", "bought-listed")
    own = _from_favourites(favourites, lists, known, n).join(known, pair, "left_anti")
    own = materialize(first_n(own.withColumn("_source", F.lit(0))).drop("rank"), "favourite-picks")

    found = own.groupBy(_CUSTOMER).agg(F.count(F.lit(1)).alias("_found"))
    short = customers.join(found, _CUSTOMER, "left").where(F.coalesce("_found", F.lit(0)) < n)
    short = materialize(short.select(_CUSTOMER), "short-customers")
    if short.isEmpty():
        return first_n(own).select(*_reco(), "category")
    known = _only(bought, short, _CUSTOMER, "bought-by-short")
    known = _only(known, popular, "product_id", "bought-popular")
    fill = (
        _from_popular(short, known, popular, n)
        .join(known.unionByName(own.select(*pair)), pair, "left_anti")
        .select(
            _CUSTOMER,
            "product_id",
            "category",
            F.col("popularity_rank").alias("_position"),
            F.lit(1).alias("_source"),
        )
    )
    return first_n(own.unionByName(fill)).select(*_reco(), "category")


def recommend(
    fact: DataFrame,
    popular: DataFrame,
    n: int = 5,
    per_category: int = PER_CATEGORY,
    bought: DataFrame | None = None,
    items: DataFrame | None = None,
) -> DataFrame:
    """customer_unique_id, product_id, rank, score for every customer with a purchase.

    `bought` overrides which (customer, product) pairs are left out, `items` is
    customer_items(fact) if there is one already.
    """
    items = customer_items(fact) if items is None else items
    return _recommend(
        items.select(_CUSTOMER).distinct(),
        _favourites(items),
        _bought(items) if bought is None else bought,
        popular,
        n,
        per_category,
    ).drop("category")


def hit_rate(
    fact: DataFrame,
    popular: DataFrame,
    k: int = 10,
    n_users: int | None = 500,
    seed: int = 42,
    leak_free: bool = False,
    per_category: int = PER_CATEGORY,
    items: DataFrame | None = None,
) -> DataFrame:
    """Share of customers whose k recommendations show the category of a held-out product.

    Of n_users customers (all for None) those with two products or more are
    asked; one product each, picked by hash, is treated as not bought.
    random_baseline is in percent. Favourite categories still know the held-out
    purchase unless `leak_free`. With `items` only the categories of `fact` are read.
    """
    pair = [_CUSTOMER, "product_id"]
    items = customer_items(fact) if items is None else items
    held = (
        items.where(F.col("product_id").isNotNull())
        .groupBy(*pair)
        .agg(F.min("category").alias("category"))
        .groupBy(_CUSTOMER)
        .agg(
            F.count(F.lit(1)).alias("_products"),
            F.min_by(
                F.struct("product_id", "category"),
                F.struct(hash_number(*pair), "product_id"),
            ).alias("_held"),
        )
    )
    if n_users is not None:
        held = hash_sample(materialize(held, "held-candidates"), [_CUSTOMER], n_users, seed)
    held = materialize(
        held.where("_products >= 2").select(
            _CUSTOMER,
            F.col("_held.product_id").alias("product_id"),
            F.col("_held.category").alias("_category"),
        ),
        "held-out",
    )
    asked = held.select(_CUSTOMER)
    if n_users is not None:
        items = _only(items, asked, _CUSTOMER, "asked-items")
    kept = items.join(held.select(*pair), pair, "left_anti")
    favourites = _favourites(kept if leak_free else items)
    if n_users is None:
        favourites = favourites.join(asked, _CUSTOMER, "left_semi")
    recos = _recommend(asked, favourites, _bought(kept), popular, k, per_category)
    hits = (
        held.join(recos.select(_CUSTOMER, "category"), _CUSTOMER, "left")
        .groupBy(_CUSTOMER)
        .agg(F.max(F.coalesce(F.col("category") == F.col("_category"), F.lit(False))).alias("hit"))
    )
    categories = fact.agg(F.countDistinct("product_category_name_english")).scalar()
    return hits.agg(
        F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("hit_rate"),
        F.count(F.lit(1)).alias("n_evaluated"),
    ).withColumn("random_baseline", F.try_divide(F.lit(100.0), categories))


def reco_lookup(ids: DataFrame, recos: DataFrame, popular: DataFrame, n: int = 10) -> DataFrame:
    """Up to n recommendations per requested id; an unknown id gets the n popular products.

    Columns: customer_unique_id, fallback, rank, product_id, score, category;
    score is NULL for a fallback, category for a recommendation.
    """
    ids = ids.select(_CUSTOMER).distinct()
    known = ids.join(recos.where(F.col("rank") <= n), _CUSTOMER).select(
        _CUSTOMER,
        F.lit(False).alias("fallback"),
        "rank",
        "product_id",
        "score",
        F.lit(None).cast("string").alias("category"),
    )
    top = popular.where(F.col("popularity_rank") <= n).select(
        F.col("popularity_rank").cast("int").alias("rank"), "product_id", "category"
    )
    unknown = ids.join(recos.select(_CUSTOMER), _CUSTOMER, "left_anti").withColumn(
        "rank", F.explode(F.sequence(F.lit(1), F.lit(n)))
    )
    fallback = unknown.join(F.broadcast(top), "rank").select(  # n rows
        _CUSTOMER,
        F.lit(True).alias("fallback"),
        "rank",
        "product_id",
        F.lit(None).cast("double").alias("score"),
        "category",
    )
    return known.unionByName(fallback)

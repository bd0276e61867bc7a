"""The figures behind every exploratory chart; drawing is left to the caller.

Group keys that are missing are dropped here, as a data frame group-by does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.columns import ratio, round_half_even, share_pct
from storelens.functions.quantiles import exact_quantiles
from storelens.functions.sampling import hash_sample
from storelens.functions.skew import left_join
from storelens.operators import sales
from storelens.operators.cleaning import WEEKDAYS
from storelens.operators.rfm import SCORES


def missing_values(df: DataFrame) -> DataFrame:
    """column, n_missing for every column that misses any, most first; one pass."""

    def missing(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return c.isNull() | F.isnan(c)
        return c.isNull()

    counts = df.agg(*[F.count_if(missing(f)).alias(f.name) for f in df.schema])
    return (
        counts.unpivot([], df.columns, "column", "n_missing")
        .where("n_missing > 0")
        .orderBy(F.desc("n_missing"), "column")
    )


def orders_by_weekday(fact: DataFrame) -> DataFrame:
    """Distinct orders per weekday, Monday first; a day without orders shows 0."""
    days = fact.sparkSession.range(1).select(
        F.posexplode(F.array(*map(F.lit, WEEKDAYS))).alias("position", "day_of_week")
    )
    counts = fact.groupBy("day_of_week").agg(F.countDistinct("order_id").alias("orders"))
    return (
        days.join(counts, "day_of_week", "left")
        .select("position", "day_of_week", F.coalesce("orders", F.lit(0)).alias("orders"))
        .orderBy("position")
    )


def delivery_stats(orders: DataFrame) -> DataFrame:
    """Mean, median and maximum of whole delivery days."""
    return sales.delivery_days(orders).agg(
        ratio(F.sum("delivery_days"), F.count("delivery_days")).alias("mean"),
        F.percentile("delivery_days", F.lit(0.5)).alias("median"),
        F.max("delivery_days").alias("max"),
    )


def category_month_matrix(fact: DataFrame, n: int = 10) -> DataFrame:
    """Revenue of the n best categories in each calendar month, m1..m12, 0 where none."""
    cells = (
        fact.where(F.col("product_category_name_english").isNotNull())
        .groupBy(F.col("product_category_name_english").alias("category"), "month")
        .agg(F.sum("total_amount").alias("amount"))
    )

    def month(m: int) -> Column:
        amount = F.sum(F.when(F.col("month") == m, F.col("amount")))
        return F.round(F.coalesce(amount, F.lit(0)), 2).cast("double").alias(f"m{m}")

    return (
        cells.groupBy("category")
        .agg(*[month(m) for m in range(1, 13)], F.sum("amount").alias("_total"))
        .orderBy(F.desc("_total"), "category")
        .limit(n)
        .drop("_total")
    )


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, at two digits."""
    quartiles = exact_quantiles(df, cols)
    stats = (
        df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot([], cols, "column", "value")
        .groupBy("column")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )

    def two(c: str, name: str) -> Column:
        return round_half_even(c).alias(name)

    return (
        stats.join(quartiles, "column")
        .select(
            "column",
            "count",
            two("mean", "mean"),
            two("std", "std"),
            two("min", "min"),
            two("q0", "p25"),
            two("q1", "p50"),
            two("q2", "p75"),
            two("max", "max"),
        )
        .orderBy("column")
    )


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles per group and whiskers at the last values within 1.5 quartile ranges."""
    q = exact_quantiles(df, [col], by=by).select(
        by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    value = F.col(col).cast("double")
    inside = left_join(df.select(by, value.alias("_value")), q, by, "inner").where(
        (F.col("_value") >= F.col("q1") - reach) & (F.col("_value") <= F.col("q3") + reach)
    )
    return (
        inside.groupBy(by, "q1", "median", "q3")
        .agg(F.min("_value").alias("lo_whisker"), F.max("_value").alias("hi_whisker"))
        .orderBy(by)
    )


def score_distribution(scores: DataFrame) -> DataFrame:
    """Customers per value of each quartile score."""
    return (
        scores.groupBy(*SCORES)
        .agg(F.count(F.lit(1)).alias("cell"))
        .unpivot(["cell"], list(SCORES), "score_name", "score")
        .groupBy("score_name", "score")
        .agg(F.sum("cell").alias("n"))
        .orderBy("score_name", "score")
    )


def best_month(fact: DataFrame, since: str | None = None) -> DataFrame:
    """The month with the highest revenue; the earliest on ties."""
    return (
        sales.monthly_sales(fact.where(F.col("year_month").isNotNull()), since)
        .select("year_month", "revenue")
        .orderBy(F.desc("revenue"), "year_month")
        .limit(1)
    )


def share_of(df: DataFrame, col: str, value: object, name: str = "pct") -> DataFrame:
    """Share of rows whose column equals the value, in percent."""
    return df.agg(share_pct(F.count_if(F.col(col) == value), F.count(F.lit(1))).alias(name))


def insights(
    fact: DataFrame,
    orders: DataFrame,
    reviews: DataFrame,
    payments: DataFrame,
    since: str | None = "2017-01",
    card: str = "credit_card",
) -> DataFrame:
    """Ten headline facts as text, in a fixed order."""

    def amount(c: str) -> Column:
        return F.format_number(c, 2)

    totals = sales.kpis(fact).select(
        F.concat(amount("total_revenue"), F.lit(" BRL")).alias("Total Revenue"),
        F.format_number("total_orders", 0).alias("Total Orders"),
        F.format_number("total_customers", 0).alias("Total Customers"),
        F.concat(F.replace(amount("avg_order_value"), F.lit(","), F.lit("")), F.lit(" BRL")).alias(
            "Avg Order Value"
        ),
    )
    named = fact.where(F.col("product_category_name_english").isNotNull())
    placed = fact.where(F.col("customer_city").isNotNull() & F.col("customer_state").isNotNull())
    single = {
        "Top Category": sales.top_categories(named, 1).select("category"),
        "Top City": sales.top_cities_label(placed, 1).select("city"),
        "Best Month": best_month(fact, since).select(
            F.concat("year_month", F.lit(" ("), amount("revenue"), F.lit(" BRL)"))
        ),
        "Avg Delivery": delivery_stats(orders).select(
            F.concat(amount("mean"), F.lit(" days"))
        ),
        "5-star Reviews": share_of(reviews, "review_score", 5).select(
            F.concat(amount("pct"), F.lit("%"))
        ),
        "Credit Card Share": share_of(payments, "payment_type", card).select(
            F.concat(amount("pct"), F.lit("%"))
        ),
    }
    row = totals.withColumns({name: df.scalar() for name, df in single.items()})
    names = row.columns
    return row.select(
        F.posexplode(
            F.array(*[
                F.struct(F.lit(n).alias("insight"), F.col(f"`{n}`").alias("value")) for n in names
            ])
        ).alias("position", "fact")
    ).select((F.col("position") + 1).alias("position"), "fact.insight", "fact.value")


def plot_sample(df: DataFrame, key: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """n rows that look random but are the same in every run."""
    return hash_sample(df, [key], n, seed)


def reco_category_mix(
    recos: DataFrame, popular: DataFrame, n: int = 15, sample: int | None = None
) -> DataFrame:
    """Categories among the recommended products, most frequent first.

    Recommendations are counted per product before the join, since the best
    products are recommended to a large part of all customers.
    """
    if sample is not None:
        recos = hash_sample(recos, ["customer_unique_id", "product_id"], sample)
    per_product = recos.groupBy("product_id").agg(F.count(F.lit(1)).alias("times"))
    return (
        per_product.join(popular.select("product_id", "category"), "product_id")
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("times").alias("n"))
        .orderBy(F.desc("n"), "category")
        .limit(n)
    )

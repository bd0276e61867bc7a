"""

Parameters of the registered queries are fixed in FIXTURES.md, section 5.
"""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from storelens.functions.binning import histogram, kde  # noqa: E402
from storelens.functions.columns import hash_fraction, short_id  # noqa: E402
from storelens.functions.ranking import global_rank  # noqa: E402
from storelens.operators import (     boosting,
 # noqa: E402
    churn,
    cleaning,
    eda,
    evaluate,
    model_checks,
    quality,
    questions,
    recommend,
    rfm,
    sales,
    segments,
    star,
)
from storelens.plans import business_questions, experiments, sqlpack  # noqa: E402
from storelens.plans.mart import FIXED_CENTRES, Mart  # noqa: E402
from storelens.session import materialize, scratch  # noqa: E402
from storelens.sources import surrogate, tables  # noqa: E402
from storelens.sources.csv import load_raw  # noqa: E402

try:  # the training-data operators are an optional part
    import corpus_pipeline
    from storelens.llm import queries as llm
except ImportError as absent:
    logging.getLogger(__name__).warning("without the training-data operators: %s", absent)
    corpus_pipeline = llm = None

MIN_PURCHASES = 30
LOOKUP_ID = "Customer#000000007"
SINCE = "2000-01"
BOOSTED_FEATURES = ("frequency", "lifetime_days", "n_items", "n_products", "n_sellers")  # whole numbers: exact bins
CSV_PARTS, CSV_ROWS = 3, 500_000  # least parts of a written table, most rows of a part
REVIEW_BOUND = 1600  # at sf0.01 half of the categories have fewer

_marts: dict[tuple[str, str], Mart] = {}


def mart(spark: SparkSession, sf_dir: str) -> Mart:
    """The tables over one data folder, built on first use within the application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _marts:
        raw = surrogate.raw_tables(spark, sf_dir)
        _marts[key] = Mart(raw, min_purchases=MIN_PURCHASES, centres=FIXED_CENTRES)
    return _marts[key]


def _double(df: DataFrame, *cols: str) -> DataFrame:
    """Exact amounts leave a registered query as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _curve(df: DataFrame) -> DataFrame:
    """A density curve with its grid and values rounded for comparison."""
    return df.withColumns({"x": F.round("x", 3), "density": F.round("density", 12)})


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Sums of transcendental terms depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _hash_score() -> Column:
    """A fixed score with many ties, so that evaluation can be compared exactly."""
    return F.floor(100 * hash_fraction("customer_unique_id")).cast("double") / F.lit(100.0)


def _scored(m: Mart) -> DataFrame:
    """label, score and prediction of every customer, with the fixed score."""
    return evaluate.scored(_churn_table(m), "churn", "churn_probability", "churn_prediction")


def _churn_table(m: Mart) -> DataFrame:
    """A churn table whose probability is the fixed score instead of a model's."""
    return (
        churn.label_churn(_double(m.rfm, "monetary"))
        .withColumn("churn_probability", _hash_score())
        .withColumn("churn_prediction", (F.col("churn_probability") > 0.5).cast("int"))
    )


def _gappy_features(m: Mart) -> DataFrame:
    """Customer features before imputation, with the gaps that ratios can leave."""
    return (
        _double(m.rfm, "monetary")
        .withColumn("per_day", F.when(F.col("recency") % 7 == 0, float("inf")).otherwise(
            F.col("monetary") / F.col("recency")))
        .withColumn("spend", F.when(F.col("frequency") % 5 != 0, F.col("monetary")))
        .select("customer_unique_id", "recency", "per_day", "spend")
    )


def _table_preview(spark: SparkSession, m: Mart) -> DataFrame:
    tables.register({"storelens_fact_sales": m.fact_sales})
    return tables.preview(spark, "storelens_fact_sales", 100)


def _top_categories_param(spark: SparkSession, m: Mart) -> DataFrame:
    tables.register({"storelens_fact_sales": m.fact_sales})
    text = """
        SELECT product_category_name_english AS category,
               CAST(ROUND(SUM(total_amount), 2) AS DOUBLE) AS revenue
        FROM storelens_fact_sales
        WHERE year_month >= :since
        GROUP BY product_category_name_english
        ORDER BY revenue DESC, category
        LIMIT :n
    """
    return sqlpack.run_single(spark, text, {"since": SINCE, "n": 5})


def _segment_rows(m: Mart) -> DataFrame:
    return _double(m.customer_segments, "monetary")


def _tested(m: Mart, model: str) -> DataFrame:
    """Test metrics of one of the fitted models."""
    return evaluate.all_metrics(m.trained.tested[model])


def _feature_importance(m: Mart) -> DataFrame:
    return churn.feature_importance(m.trained.models["RandomForest"])


def _gappy_fact(m: Mart) -> DataFrame:
    """The fact table with the amounts and the dates of some customers missing."""
    n = F.substring("customer_unique_id", 10, 20).cast("bigint")
    return m.fact_sales.withColumns({
        "total_amount": F.when(n % 11 != 0, F.col("total_amount")),
        "order_purchase_timestamp": F.when(n % 13 != 0, F.col("order_purchase_timestamp")),
    })


def _rfm_gaps(m: Mart) -> DataFrame:
    return _double(rfm.rfm_scores(materialize(rfm.rfm(_gappy_fact(m)), "rfm-gaps")), "monetary")


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw table written as CSV parts and loaded again: rows, and whether they are the same."""
    folder = scratch(spark, "csv")
    raw = surrogate.raw_tables(spark, sf_dir)
    for name, df in raw.items():
        parts = max(CSV_PARTS, 1 + df.count() // CSV_ROWS)
        df.repartition(parts).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    loaded = load_raw(spark, folder)
    rows = []
    for name, df in raw.items():
        back = loaded[name].select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes])
        rows.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(tables.same_rows(df, back)).alias("same")))
    return reduce(DataFrame.unionByName, rows)


def _stored_alike(spark: SparkSession, written: dict[str, DataFrame]) -> DataFrame:
    """Tables stored and read back: rows of each, and whether none is lost or added."""
    folder = scratch(spark, "stored")
    tables.save_tables(written, folder)
    loaded = tables.load_all(spark, folder)
    rows = []
    for name, df in written.items():
        rows.append(loaded[name].agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(tables.same_rows(df, loaded[name])).alias("same")))
    return reduce(DataFrame.unionByName, rows)


def _built(m: Mart) -> DataFrame:
    """The whole warehouse built again from the raw tables: rows of each table."""
    return tables.table_inventory(star.build_warehouse(m.raw))


def _model_reload(spark: SparkSession, m: Mart) -> DataFrame:
    """Customers, and whether the best model scores them alike after saving and loading."""
    path, best = scratch(spark, "model"), m.trained.best()
    tables.save_model(m.trained.models[best], path)
    again = churn.score_customers(tables.load_model(path), m.churn_features)
    pair = m.customer_churn.select("customer_unique_id", "churn_probability").join(
        again.select("customer_unique_id", F.col("churn_probability").alias("again")),
        "customer_unique_id")
    return pair.agg(
        F.count(F.lit(1)).alias("n_customers"),
        (F.max(F.abs(F.col("churn_probability") - F.col("again"))) < 1e-12).alias("same"))


def _digest(df: DataFrame) -> Column:
    """A hash of all values of a report: rows as text, in the order of that text."""
    cells = [
        F.coalesce((F.col(f"`{c}`").cast("decimal(20,2)") if t.startswith(("double", "decimal")) else F.col(f"`{c}`"))
                   .cast("string"), F.lit("NULL")) for c, t in df.dtypes]
    return F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *cells))), "\n").cast("binary"))


def _question_pack(spark: SparkSession, m: Mart) -> DataFrame:
    """Every question of the pack with its rows and a hash of their values; the broken one stops nothing."""
    tables.register({f"storelens_{n}": df for n, df in (
        ("fact_sales", m.fact_sales), ("orders", m.orders), ("payments", m.payments),
        ("reviews", m.reviews))})
    pack = business_questions.PACK | {"broken": "SELECT no_such_column FROM storelens_orders"}
    found = sqlpack.run_pack(spark, pack)
    ran = [df.agg(F.count(F.lit(1)).alias("n_rows"), _digest(df).alias("digest")).select(
        F.lit(name).alias("question"), "n_rows", F.lit(True).alias("ran"), "digest")
        for name, df in found.items() if isinstance(df, DataFrame)]
    failed = [(name, 0, False, None) for name, df in found.items() if isinstance(df, str)]
    return reduce(DataFrame.unionByName, ran).unionByName(
        spark.createDataFrame(failed, "question string, n_rows long, ran boolean, digest string"))


def _served_shapes(m: Mart) -> DataFrame:
    """What callers of the served results rely on, as rows."""
    kinds = F.collect_set("segment")
    unknown = "no such customer"
    rows = [
        sales.top_categories(m.fact_sales, 5).agg((F.count(F.lit(1)) <= 5).alias("ok"))
        .select(F.lit("top_categories_limit").alias("shape"), "ok"),
        sales.top_cities(m.fact_sales, 5).agg((F.count(F.lit(1)) <= 5).alias("ok"))
        .select(F.lit("top_cities_limit").alias("shape"), "ok"),
        sales.segment_summary(m.customer_segments).agg(
            ((F.size(kinds) == 5) & F.array_contains(kinds, "VIP") & F.array_contains(kinds, "Loyal")).alias("ok"))
        .select(F.lit("five_segments").alias("shape"), "ok"),
        sales.segment_lookup(m.customer_segments, unknown).agg((F.count(F.lit(1)) == 0).alias("ok"))
        .select(F.lit("unknown_segment").alias("shape"), "ok"),
        sales.top_risk(_churn_table(m), 5).agg((F.count("churn_probability") <= 5).alias("ok"))
        .select(F.lit("top_risk_limit").alias("shape"), "ok"),
        recommend.reco_lookup(
            m.rfm.sparkSession.createDataFrame([(unknown,)], "customer_unique_id string"),
            m.recommendations, m.popular_products,
        ).agg((F.count_if("fallback") == F.count(F.lit(1))).alias("ok"))
        .select(F.lit("unknown_gets_fallback").alias("shape"), "ok"),
        sales.popular_products_top(m.popular_products, 5).agg((F.count(F.lit(1)) <= 5).alias("ok"))
        .select(F.lit("popular_limit").alias("shape"), "ok"),
    ]
    return reduce(DataFrame.unionByName, rows)


def _answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mart(spark, sf_dir)
    result = questions.format_results(sales.top_categories(m.fact_sales))
    return questions.answer_table(
        questions.question_top_n(questions.question_topics(surrogate.questions(spark, sf_dir))),
        result)


def _visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, and all suppliers standing for ids without a recommendation."""
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name")
    strangers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name")
    return known.union(strangers).toDF("customer_unique_id")


def entry(spark: SparkSession) -> DataFrame:
    """Revenue, orders, customers and average order value of the smallest data set."""
    raw = surrogate.raw_tables(spark, "/root/testdata/sf0.001")
    return sales.kpis(star.build_warehouse(raw)["fact_sales"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each takes (spark, sf_dir)."""
    on_mart: dict[str, Callable[[Mart], DataFrame]] = {
        # cleaning and the star schema
        "clean_products": lambda m: cleaning.clean_products(m.raw["products"]),
        "translate_categories": lambda m: m.products.select(
            "product_id", "product_category_name", "product_category_name_english"
        ),
        "date_features": lambda m: cleaning.date_features(
            m.raw["orders"].select("order_id", "order_purchase_timestamp")
        ),
        "payment_rollup": lambda m: _double(cleaning.payment_rollup(m.payments), "payment_value"),
        "fact_sales": lambda m: _double(
            m.fact_sales, "price", "freight_value", "total_amount", "payment_value"
        ),
        "dim_customers": lambda m: m.warehouse["dim_customers"],
        "dim_products": lambda m: m.warehouse["dim_products"],
        "dim_sellers": lambda m: m.warehouse["dim_sellers"],
        "table_inventory": lambda m: tables.table_inventory(m.warehouse),
        "build_warehouse": _built,
        "expected_tables": lambda m: quality.expected_tables(
            m.warehouse | m.derived() | {"customer_churn": _churn_table(m)}, m.fact_sales.sparkSession),
        "required_columns": lambda m: quality.required_columns(m.fact_sales),
        "served_shapes": _served_shapes,
        "review_by_category_bound": lambda m: sales.review_by_category(m.fact_sales, m.reviews, REVIEW_BOUND),
        "hit_rate_500": lambda m: recommend.hit_rate(
            m.purchases, m.popular_products, n_users=500, items=m.customer_items),
        "short_ids": lambda m: m.popular_products.select(
            "product_id", *[short_id("product_id", n).alias(f"short_{n}") for n in (10, 15, 20, 30)]
        ).unionByName(
            m.rfm.select(
                F.lit(None).cast("bigint").alias("product_id"),
                *[short_id("customer_unique_id", n).alias(f"short_{n}") for n in (10, 15, 20, 30)],
            )
        ),
        # business questions
        "total_revenue": lambda m: sales.total_revenue(m.fact_sales),
        "total_orders": lambda m: sales.total_orders(m.fact_sales),
        "total_customers": lambda m: sales.total_customers(m.fact_sales),
        "avg_order_value": lambda m: sales.avg_order_value(m.fact_sales),
        "kpis": lambda m: sales.kpis(m.fact_sales),
        "monthly_sales": lambda m: sales.monthly_sales(m.fact_sales),
        "monthly_sales_since": lambda m: sales.monthly_sales(m.fact_sales, SINCE),
        "top_products": lambda m: sales.top_products(m.fact_sales),
        "top_categories": lambda m: sales.top_categories(m.fact_sales),
        "top_cities": lambda m: sales.top_cities(m.fact_sales),
        "top_cities_label": lambda m: sales.top_cities_label(m.fact_sales),
        "top_city_one": lambda m: sales.top_city_one(m.fact_sales),
        "top_customers": lambda m: sales.top_customers(m.fact_sales),
        "rfm_sql": lambda m: sales.rfm_sql(m.fact_sales),
        "payment_mix": lambda m: sales.payment_mix(m.payments),
        "installments": lambda m: sales.installments(m.payments),
        "review_distribution": lambda m: sales.review_distribution(m.reviews),
        "review_by_category": lambda m: sales.review_by_category(m.fact_sales, m.reviews),
        "order_status": lambda m: sales.order_status(m.orders),
        "avg_delivery": lambda m: sales.avg_delivery(m.orders),
        # exploration
        "missing_values": lambda m: eda.missing_values(m.fact_sales),
        "orders_by_weekday": lambda m: eda.orders_by_weekday(m.fact_sales),
        "delivery_stats": lambda m: eda.delivery_stats(m.orders),
        "histogram_delivery": lambda m: histogram(sales.delivery_days(m.orders), "delivery_days"),
        "histogram_rfm": lambda m: histogram(m.rfm, "recency")
        .withColumn("measure", F.lit("recency"))
        .unionByName(histogram(m.rfm, "frequency").withColumn("measure", F.lit("frequency")))
        .unionByName(histogram(m.rfm, "monetary").withColumn("measure", F.lit("monetary"))),
        "kde_delivery": lambda m: _curve(kde(sales.delivery_days(m.orders), "delivery_days")),
        "kde_rfm": lambda m: _curve(
            kde(m.rfm, "recency")
            .withColumn("measure", F.lit("recency"))
            .unionByName(kde(m.rfm, "frequency").withColumn("measure", F.lit("frequency")))
            .unionByName(kde(m.rfm, "monetary").withColumn("measure", F.lit("monetary")))
        ),
        "category_month_matrix": lambda m: eda.category_month_matrix(m.fact_sales),
        "best_month": lambda m: eda.best_month(m.fact_sales),
        "insights": lambda m: eda.insights(
            m.fact_sales, m.orders, m.reviews, m.payments, since=SINCE, card="1-URGENT"
        ),
        "plot_sample": lambda m: _double(eda.plot_sample(m.rfm, "customer_unique_id"), "monetary"),
        "plot_sample_500": lambda m: _double(
            eda.plot_sample(m.rfm, "customer_unique_id", n=500), "monetary"
        ),
        "dq_report": lambda m: quality.dq_report(
            {
                "fact_sales": m.fact_sales,
                "customer_segments": m.customer_segments,
                "customer_churn": _churn_table(m),
            }
        ),
        # recency, frequency, monetary and segments
        "rfm": lambda m: _double(m.rfm, "monetary"),
        "rfm_describe": lambda m: eda.describe(m.rfm, ["recency", "frequency", "monetary"]),
        "frequency_rank": lambda m: global_rank(
            m.rfm.select("customer_unique_id", "frequency"),
            ["frequency", "customer_unique_id"],
            "frequency_rank",
        ),
        "rfm_scores": lambda m: _double(m.rfm_scores, "monetary"),
        "score_distribution": lambda m: eda.score_distribution(m.rfm_scores),
        "standardise_scores": lambda m: _rounded(
            segments.standardise(
                m.rfm_scores.select("customer_unique_id", "R_score", "F_score", "M_score"),
                ["R_score", "F_score", "M_score"],
            ),
            9, "z_R_score", "z_F_score", "z_M_score",
        ),
        "assign_to_centres": lambda m: m.clustered.select(
            "customer_unique_id", "R_score", "F_score", "M_score", "cluster"
        ),
        "silhouette": lambda m: _rounded(segments.silhouette(m.clustered), 9, "silhouette"),
        "segment_profile": lambda m: m.segment_profile,
        "segment_table": lambda m: _segment_rows(m),
        "segment_distribution": lambda m: segments.segment_distribution(m.customer_segments),
        "segment_summary": lambda m: sales.segment_summary(m.customer_segments),
        "segment_lookup": lambda m: sales.segment_lookup(_segment_rows(m), LOOKUP_ID),
        "segment_box": lambda m: eda.box_stats(m.customer_segments, "monetary", "segment"),
        "kmeans_segments": lambda m: _double(segments.kmeans_segments(m.rfm_scores), "monetary"),
        "elbow": lambda m: segments.elbow(m.rfm_scores),
        "best_k": lambda m: segments.best_k(m.silhouette_by_k),
        "silhouette_by_k": lambda m: m.silhouette_by_k,
        # churn
        "customer_reviews": lambda m: churn.customer_reviews(m.fact_sales, m.reviews),
        "churn_features": lambda m: m.raw_features,
        "churn_rate": lambda m: churn.churn_rate(churn.label_churn(m.rfm)),
        "impute_median": lambda m: churn.impute_median(_gappy_features(m), ["per_day", "spend"]),
        "stratified_split": lambda m: churn.stratified_split(
            churn.label_churn(m.rfm).select("customer_unique_id", "churn")
        ),
        "stratified_split_exact": lambda m: churn.stratified_split(
            churn.label_churn(m.rfm).select("customer_unique_id", "churn"), exact=True
        ),
        "class_weights": lambda m: churn.class_weights(
            churn.label_churn(m.rfm).select("customer_unique_id", "churn")
        ),
        "tracked_features": lambda m: churn.tracked_features(m.customer_segments),
        "confusion": lambda m: evaluate.confusion(_scored(m)),
        "classification_metrics": lambda m: evaluate.classification_metrics(_scored(m)),
        "roc_auc": lambda m: evaluate.roc_auc(_scored(m)),
        "roc_curve": lambda m: evaluate.roc_curve(_scored(m)),
        "score_density": lambda m: histogram(_scored(m), "score", 30, "label"),
        "churn_bands": lambda m: churn_bands_of(m),
        "churn_summary": lambda m: sales.churn_summary(_churn_table(m)),
        "churn_lookup": lambda m: sales.churn_lookup(_churn_table(m), LOOKUP_ID),
        "top_risk": lambda m: sales.top_risk(_churn_table(m)),
        "churn_lr": lambda m: _tested(m, "LogisticRegression"),
        "churn_rf": lambda m: _tested(m, "RandomForest"),
        "churn_gbt": lambda m: _tested(m, "GradientBoosting"),
        "model_comparison": lambda m: m.trained.comparison(),
        "feature_importance": _feature_importance,
        "customer_churn": lambda m: m.customer_churn,
        "run_log": lambda m: m.runs,
        # what must hold of the fitted models
        "customer_churn_check": lambda m: model_checks.churn_scores(m.customer_churn),
        "tested_models_check": lambda m: model_checks.tested_models(m.trained),
        "boosted_first_cut": lambda m: boosting.first_tree(
            m.churn_features, BOOSTED_FEATURES, "churn", bins=16
        ).withColumns({"gain": F.round("gain", 6), "leaf": F.round("leaf", 9)}),
        "churn_lr_check": lambda m: model_checks.lr_is_optimal(m.trained, m.churn_features),
        "model_comparison_check": lambda m: model_checks.comparison_is_sound(m.trained.comparison()),
        "feature_importance_check": lambda m: model_checks.importance_is_sound(_feature_importance(m)),
        "kmeans_segments_check": lambda m: model_checks.clusters_are_nearest(
            segments.kmeans_segments(m.rfm_scores), m.clustered
        ),
        "best_k_check": lambda m: model_checks.curve_is_sound(
            m.silhouette_by_k, segments.elbow(m.rfm_scores), segments.best_k(m.silhouette_by_k)
        ),
        "run_log_check": lambda m: model_checks.runs_are_sound(m.runs),
        "best_run": lambda m: experiments.best_run(m.runs).select(
            F.length("run_name").between(12, 18).alias("named"),
            (F.col("metrics")["roc_auc"] == m.runs.agg(
                F.max(F.col("metrics")["roc_auc"])).scalar()).alias("is_highest"),
            F.col("params")["model_path"].isNotNull().alias("has_model"),
        ),
        "rfm_scores_gaps": _rfm_gaps,
        # recommendation
        "popular_products": lambda m: m.popular_products.drop("popularity_rank"),
        "popularity_rank": lambda m: m.popular_products.select("product_id", "popularity_rank"),
        "popular_products_top": lambda m: sales.popular_products_top(m.popular_products),
        "category_stats": lambda m: recommend.category_stats(m.fact_sales),
        "customer_history": lambda m: recommend.customer_history(m.fact_sales),
        "favourite_categories": lambda m: recommend.favourite_categories(m.fact_sales),
        "top_per_category": lambda m: recommend.top_per_category(m.popular_products),
        "recommendations": lambda m: m.recommendations,
        "recommendations_fill": lambda m: recommend.recommend(
            m.purchases, m.popular_products, n=30, per_category=1, items=m.customer_items
        ),
        "reco_category_mix": lambda m: eda.reco_category_mix(m.recommendations, m.popular_products),
        "hit_rate": lambda m: recommend.hit_rate(
            m.purchases, m.popular_products, n_users=None, items=m.customer_items
        ),
        "hit_rate_leak_free": lambda m: recommend.hit_rate(
            m.purchases, m.popular_products, n_users=None, leak_free=True, items=m.customer_items
        ),
        # questions
        "format_results": lambda m: questions.format_results(sales.monthly_sales(m.fact_sales)),
    }
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        name: (lambda spark, sf_dir, build=build: build(mart(spark, sf_dir)))
        for name, build in on_mart.items()
    }
    out |= {
        "clean_orders": lambda spark, sf_dir: cleaning.clean_orders(
            surrogate.orders_as_text(spark, sf_dir)
        ),
        "table_preview": lambda spark, sf_dir: _table_preview(spark, mart(spark, sf_dir)),
        "top_categories_param": lambda spark, sf_dir: _top_categories_param(
            spark, mart(spark, sf_dir)
        ),
        "table_preview_check": lambda spark, sf_dir: model_checks.preview_is_sound(
            _table_preview(spark, mart(spark, sf_dir)), mart(spark, sf_dir).fact_sales,
            ["order_id", "order_item_id"], 100,
        ),
        "csv_roundtrip": _csv_roundtrip,
        "save_load": lambda spark, sf_dir: _stored_alike(spark, mart(spark, sf_dir).warehouse),
        "derived_tables": lambda spark, sf_dir: _stored_alike(spark, mart(spark, sf_dir).derived()),
        "recommendation_artifacts": lambda spark, sf_dir: _stored_alike(
            spark, mart(spark, sf_dir).recommendation_artifacts()),
        "model_reload": lambda spark, sf_dir: _model_reload(spark, mart(spark, sf_dir)),
        "question_pack": lambda spark, sf_dir: _question_pack(spark, mart(spark, sf_dir)),
        "answer_table": _answer_table,
        "reco_lookup": lambda spark, sf_dir: recommend.reco_lookup(
            _visitors(spark, sf_dir),
            mart(spark, sf_dir).recommendations,
            mart(spark, sf_dir).popular_products,
        ),
        "question_topics": lambda spark, sf_dir: questions.question_topics(
            surrogate.questions(spark, sf_dir)
        ),
        "question_top_n": lambda spark, sf_dir: questions.question_top_n(
            surrogate.questions(spark, sf_dir)
        ),
    }
    if llm:
        out |= llm.queries()
        out["pipeline"] = corpus_pipeline.run
    return out


def churn_bands_of(m: Mart) -> DataFrame:
    return sales.churn_bands(_churn_table(m).select("customer_unique_id", "churn_probability"))


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query, written against the given tables only."""
    sql = oracles.all_sql()
    if llm:
        sql |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql

"""All tables of the project over one set of raw tables, each built when first asked for.

Tables that several readers share and that cost a shuffle to build are written
once to the shared folder and read from there, as a nightly build would leave
them; the rest are plain projections of the raw tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from storelens.operators import churn, recommend, rfm, segments, star
from storelens.operators.cleaning import add_category_translation, clean_orders, clean_products
from storelens.plans.experiments import Trained, tracked_experiment, train_models
from storelens.session import fit_shuffles, materialize, scratch
from storelens.sources.tables import read_runs, save_tables

# Centres in (R, F, M) score space for segments that must not depend on a seed (FIXTURES.md).
FIXED_CENTRES = [(4, 4, 4), (4, 2, 2), (2, 3, 4), (1, 2, 3), (2, 2, 1)]


class Mart:
    """`centres` fixes the segments; without it they come from k-means."""

    def __init__(
        self,
        raw: dict[str, DataFrame],
        min_purchases: int = recommend.MIN_PURCHASES,
        centres: list[tuple[float, ...]] | None = None,
    ) -> None:
        self.raw = raw
        for spark in {df.sparkSession for df in raw.values()}:
            fit_shuffles(spark, raw.values())
        self.min_purchases = min_purchases
        self.centres = centres

    @cached_property
    def orders(self) -> DataFrame:
        return materialize(clean_orders(self.raw["orders"]), "orders")

    @cached_property
    def products(self) -> DataFrame:
        return materialize(
            add_category_translation(
                clean_products(self.raw["products"]), self.raw["category_translation"]
            ), "products",
        )

    @cached_property
    def fact_sales(self) -> DataFrame:
        fact = star.build_fact_sales(
            self.orders,
            self.raw["order_items"],
            self.products,
            self.raw["customers"],
            self.payments,
        )
        return materialize(fact, "fact-sales")

    @cached_property
    def reviews(self) -> DataFrame:
        """Written on first use: as raw CSV every reader would parse it again, a file to a task."""
        return materialize(self.raw["reviews"], "reviews")

    @cached_property
    def payments(self) -> DataFrame:
        return materialize(self.raw["payments"], "payments")

    @cached_property
    def warehouse(self) -> dict[str, DataFrame]:
        return {
            "fact_sales": self.fact_sales,
            "dim_customers": star.build_dim_customers(self.raw["customers"]),
            "dim_products": star.build_dim_products(self.products),
            "dim_sellers": star.build_dim_sellers(self.raw["sellers"]),
            "orders": self.orders,
            "reviews": self.reviews,
            "payments": self.payments,
            "geolocation": self.raw["geolocation"],
        }

    @cached_property
    def rfm(self) -> DataFrame:
        """From the raw orders and items: of the fact table it needs four narrow columns."""
        per_order = star.build_customer_orders(
            clean_orders(self.raw["orders"]), self.raw["order_items"], self.products, self.raw["customers"]
        )
        return materialize(rfm.rfm_of_orders(per_order), "rfm")

    @cached_property
    def rfm_scores(self) -> DataFrame:
        return materialize(rfm.rfm_scores(self.rfm), "rfm-scores")

    @cached_property
    def clustered(self) -> DataFrame:
        if self.centres is not None:
            return segments.assign_to_centres(self.rfm_scores, self.centres)
        return segments.kmeans_segments(self.rfm_scores)

    @cached_property
    def silhouette_by_k(self) -> DataFrame:
        return materialize(segments.silhouette_by_k(self.rfm_scores).coalesce(1), "silhouette-by-k")

    @cached_property
    def segment_profile(self) -> DataFrame:
        return segments.segment_profile(self.clustered)

    @cached_property
    def customer_segments(self) -> DataFrame:
        return materialize(
            segments.segment_table(self.clustered, self.segment_profile), "customer-segments"
        )

    @cached_property
    def raw_features(self) -> DataFrame:
        """Customer features before label and imputation, from the raw orders, items, payments and reviews."""
        rows = star.build_order_rows(
            clean_orders(self.raw["orders"]), self.raw["order_items"], self.products,
            self.raw["customers"], self.raw["payments"],
        )
        return churn.features_of_orders(churn.order_side(rows), self.raw["reviews"])

    @cached_property
    def churn_features(self) -> DataFrame:
        return materialize(
            churn.impute_median(churn.label_churn(self.raw_features), list(churn.FEATURES)),
            "customer-features",
        )

    @cached_property
    def popular_products(self) -> DataFrame:
        popular = recommend.popular_of_purchases(self.purchases, self.min_purchases)
        return materialize(popular, "popular-products")

    @cached_property
    def recommendations(self) -> DataFrame:
        return materialize(
            recommend.recommend(self.purchases, self.popular_products, items=self.customer_items),
            "recommendations",
        )

    @cached_property
    def purchases(self) -> DataFrame:
        """From the raw orders and items, as rfm: four columns of the fact table, grouped."""
        rows = star.build_purchases(
            clean_orders(self.raw["orders"]), self.raw["order_items"], self.products, self.raw["customers"]
        )
        return recommend.grouped_purchases(rows)

    @property
    def customer_items(self) -> DataFrame:
        return recommend.known_items(self.purchases)

    @cached_property
    def trained(self) -> Trained:
        """The three churn models, fitted once."""
        return train_models(self.churn_features)

    @cached_property
    def customer_churn(self) -> DataFrame:
        """All customers scored by the best model, which has seen the training part only."""
        model = self.trained.models[self.trained.best()]
        return materialize(churn.score_customers(model, self.churn_features), "customer-churn")

    @cached_property
    def runs(self) -> DataFrame:
        """The run log of the tracked variant, its models kept beside it."""
        spark = self.fact_sales.sparkSession
        path = scratch(spark, "runs")
        tracked_experiment(self.customer_segments, path, f"{path}-models")
        return read_runs(spark, path)

    def recommendation_artifacts(self) -> dict[str, DataFrame]:
        """What a recommendation service loads: history, favourites, lists, popularity."""
        return {
            "customer_products": recommend.bought_products(self.fact_sales),
            "customer_categories": recommend.favourite_categories(self.fact_sales),
            "top_per_category": recommend.top_per_category(self.popular_products),
            "popular_products": self.popular_products,
        }

    def derived(self) -> dict[str, DataFrame]:
        """The derived tables apart from the churn scores, which need a trained model."""
        return {
            "customer_segments": self.customer_segments,
            "segment_profile": self.segment_profile,
            "recommendations": self.recommendations,
            "popular_products": self.popular_products,
            "category_stats": recommend.category_stats(self.fact_sales),
        }

    def save(self, folder: str) -> None:
        """Write the warehouse, the derived tables and the recommendation artifacts."""
        by_customer = ["customer_unique_id"]
        save_tables(
            self.warehouse | self.derived(),
            folder,
            sort_by={"customer_segments": by_customer, "recommendations": by_customer},
        )
        save_tables(self.recommendation_artifacts(), f"{folder.rstrip('/')}/artifacts")

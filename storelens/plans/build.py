"""From raw CSV files to every stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.plans.experiments import churn_build
from storelens.plans.mart import Mart
from storelens.sources.csv import load_raw


def build_all(
    spark: SparkSession, raw_folder: str, out: str, files: dict[str, str] | None = None, **settings: int
) -> dict[str, DataFrame]:
    """Warehouse, segments, recommendations, churn scores and model under `out`.

    `settings` go to the churn models. Returns the churn tables; the rest is read
    back from `out`.
    """
    mart = Mart(load_raw(spark, raw_folder, files))
    mart.save(out)
    return churn_build(mart.churn_features, out, **settings)

"""Running SQL text over registered tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from storelens.session import materialize


def run_single(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """One query; `:name` markers take their values from args, also in LIMIT."""
    return spark.sql(sql, args=args or {})


def run_pack(
    spark: SparkSession, pack: dict[str, str], args: dict | None = None, run: bool = False
) -> dict[str, DataFrame | str]:
    """name -> result, or the error text of a query that fails; the others go on.

    Results are lazy, so only planning errors show. With `run` each result is
    computed and written, and an error while running shows too.
    """
    results: dict[str, DataFrame | str] = {}
    for name, sql in pack.items():
        try:
            found = run_single(spark, sql, args)
            results[name] = materialize(found, "sql-result") if run else found
        except PySparkException as error:
            results[name] = str(error)
    return results

"""Exact quantiles with linear interpolation between neighbours.

The built-in `percentile` keeps every distinct value of a group in one task.
That is fine for day counts and small scores, whose values are few by nature,
but not for amounts. Here values are counted first, so a value that millions of
rows share becomes one row, and the counts are summed up in order by ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.ranking import running_totals
from storelens.functions.skew import is_small, left_join

QUARTILES = (0.25, 0.5, 0.75)


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: tuple[float, ...] = QUARTILES, by: str | None = None
) -> DataFrame:
    """(by,) column, n, q0, q1, ... with one q per probability; NULLs are left out."""
    keys = ([by] if by else []) + ["column"]
    pairs = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in cols
        ])
    ).alias("pair")
    counts = (
        df.select(*([by] if by else []), pairs)
        .select(*([by] if by else []), "pair.*")
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    summed = running_totals(counts, [*keys, "value"], {"_upto": "_n"}, "quantiles")
    groups = summed.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min(F.col("_upto") - F.col("_n")).alias("_start")
    )
    if by is None or is_small(groups):  # without `by` there is one row per column
        within = summed.join(F.broadcast(groups), keys)
    else:  # one group may hold most of the values
        name = F.to_json(F.struct(*keys))
        within = left_join(
            summed.withColumn("_group", name), groups.withColumn("_group", name).drop(*keys),
            "_group", "inner", known_large=True,
        ).drop("_group")
    within = within.withColumn("_upto", F.col("_upto") - F.col("_start"))
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.min(F.when(F.col("_upto") > place, F.col("value"))).alias(f"_{side}{i}"))
    found = within.groupBy(*keys).agg(F.first("n").alias("n"), *picks)
    qs = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        qs.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"q{i}"))
    return found.select(*keys, "n", *qs)

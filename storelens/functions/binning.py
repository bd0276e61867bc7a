"""Histograms and density curves as small aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.skew import left_join


def _bounds(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A single value gets a range of width one around it."""
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Equal bins from minimum to maximum, the last one closed, empty ones kept.

    Columns: (by,) bin, lo, hi, n, and density (area 1 per group) when grouped.
    """
    keys = [by] if by else []
    x = df.select(*keys, F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    span = x.groupBy(*keys).agg(
        F.min("x").alias("_min"), F.max("x").alias("_max"), F.count(F.lit(1)).alias("_total")
    )
    lo, hi = _bounds(F.col("_min"), F.col("_max"))
    span = span.select(*keys, lo.alias("_lo"), ((hi - lo) / F.lit(float(bins))).alias("_w"), "_total")
    if by:
        placed = left_join(x, span, by, "inner")
    else:
        placed = x.select(
            "x", span.select("_lo").scalar().alias("_lo"), span.select("_w").scalar().alias("_w")
        )
    slot = F.least(F.floor((F.col("x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    slots = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = slots.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "_w",
        "_total",
    )
    if by:
        out = out.withColumn("density", F.col("n") / (F.col("_total") * F.col("_w")))
    return out.drop("_w", "_total").orderBy(*keys, "bin")


VALUES_AT_ONCE = 512


def kde(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian density on an even grid from minimum to maximum, Scott bandwidth, exact.

    Equal values are counted first. Then blocks of about VALUES_AT_ONCE distinct values are summed up at
    each grid point where they lie, so a block sends `grid` sums on and the cost is the
    distinct values times the grid. Without values: no rows; without spread the density is NULL.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    stats = x.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.stddev_samp("x").alias("sd"),
    ).first()
    if not stats["n"]:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    width = (stats["sd"] or 0.0) * stats["n"] ** -0.2
    step = (stats["hi"] - stats["lo"]) / (grid - 1)
    scale = 1 / (stats["n"] * width * math.sqrt(2 * math.pi)) if width else None
    block = F.pmod(F.xxhash64("x"), F.lit(math.ceil(stats["n"] / VALUES_AT_ONCE)))
    values = (
        x.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
        .groupBy(block.alias("block")).agg(F.collect_list(F.struct("x", "c")).alias("values"))
    )

    def total(at: Column) -> Column:
        def add(so_far: Column, value: Column) -> Column:
            z = (at - value["x"]) / F.lit(width or 1.0)
            return so_far + value["c"] * F.exp(F.lit(-0.5) * z * z)

        return F.aggregate("values", F.lit(0.0), add)

    points = F.array(*[F.lit(stats["lo"] + i * step) for i in range(grid)])
    sums = values.select(F.posexplode(F.transform(points, total)).alias("point", "sum"))
    return (
        sums.groupBy("point").agg((F.sum("sum") * F.lit(scale).cast("double")).alias("density"))
        .select("point", (F.lit(stats["lo"]) + F.col("point") * F.lit(step)).alias("x"), "density")
        .orderBy("point")
    )

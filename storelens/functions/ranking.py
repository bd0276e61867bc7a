"""Ranks and running totals over a whole table without a one-task window.

The rows are sorted across the cluster by range, numbered inside each range and
written out. The numbering depends on sampled range bounds, so it has to be
frozen before anything is joined to it. One offset per range (as many rows as
there are shuffle partitions) then turns the local numbers into global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.session import materialize

_POSITION_BITS = 33  # width of the row number inside monotonically_increasing_id


def _frozen_order(df: DataFrame, order: list[Column | str], label: str) -> DataFrame:
    numbered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialize(
        numbered.select(
            *df.columns,
            F.shiftright("_at", _POSITION_BITS).cast("int").alias("_range"),
            F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
        ),
        label,
    )


def _before_each_range(totals: DataFrame, names: list[str]) -> DataFrame:
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_range",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names],
    )


def global_rank(df: DataFrame, order: list[Column | str], name: str, label: str = "rank") -> DataFrame:
    """df with `name` = 1..n in the given order, which should end in a unique key."""
    placed = _frozen_order(df, order, label)
    sizes = placed.groupBy("_range").agg((F.max("_pos") + 1).alias("rows"))
    offsets = F.broadcast(_before_each_range(sizes, ["rows"]))
    return placed.join(offsets, "_range").select(
        *df.columns, (F.col("_before_rows") + F.col("_pos") + 1).alias(name)
    )


def running_totals(
    df: DataFrame, order: list[Column | str], sums: dict[str, str], label: str = "running"
) -> DataFrame:
    """df with, for each new name, the total of a column up to and including the row."""
    placed = _frozen_order(df, order, label)
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = F.broadcast(_before_each_range(totals, list(sums)))
    so_far = (
        Window.partitionBy("_range").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    return placed.join(offsets, "_range").select(
        *df.columns,
        *[(F.col(f"_before_{n}") + F.sum(c).over(so_far)).alias(n) for n, c in sums.items()],
    )

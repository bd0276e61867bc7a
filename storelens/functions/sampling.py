"""Samples that are the same in every run and on every cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.columns import hash_number

_RANGE = 2**32


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows with the lowest hash of seed and keys, ties by the keys.

    A top-n keeps n rows per task before it merges them. Hashes are even, so rows
    far above the expected n-th one are dropped first; if that leaves too few,
    all rows are ranked.
    """
    draw = hash_number(*keys, F.lit(seed))
    rows = df.count()
    if rows > 100 * n:
        near = df.where(draw < F.lit(int(_RANGE * 2 * (n + 100) / rows)))
        if near.count() >= n:
            df = near
    return df.orderBy(draw, *keys).limit(n)

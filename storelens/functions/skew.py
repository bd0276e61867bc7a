"""Joins that keep working when one key holds a large part of the rows.

A side is broadcast only after its rows and bytes were counted and found few. Otherwise
the join shuffles on its key, and the keys that a sketch finds hot are spread
over several salts on the big side and repeated per salt on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.session import materialize

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024**2
HOT_SHARE = 0.002
_SPREAD = "_spread"


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether df stays within both bounds, by counting its rows and the bytes of its text.

    A plain aggregate: a limit would first move that many rows of every
    partition into one task.
    """
    fixed = sum(8 for f in df.schema if isinstance(f.dataType, _FIXED_WIDTH))
    varying = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
        for f in df.schema
        if not isinstance(f.dataType, _FIXED_WIDTH)
    ]
    width = sum(varying, F.lit(fixed)).cast("bigint")
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
    return found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def spread_rows(df: DataFrame) -> DataFrame:
    """Number the rows at their scan, so a retried task salts each row as before.

    A salt drawn after a shuffle could change when a map task is run again, and
    rows would be lost or doubled. A hash of the row would put all copies of
    one row under one salt.
    """
    return df.withColumn(_SPREAD, F.monotonically_increasing_id())


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list[tuple[object, int]]:
    """(key, salts) for each key above `share` of the rows: at most 1/share of them.

    One column is read, nothing is shuffled but a sketch of fixed size.
    """
    most = int(1 / share)
    found = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"approx_top_k(`{key}`, {most}, {max(10_000, most)})").alias("top"),
    ).first()
    limit = found["n"] * share
    return [
        (item["item"], -int(-item["count"] // limit))
        for item in found["top"] or []
        if item["count"] > limit
    ]


def left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    known_large: bool = False,
    hot_in: DataFrame | None = None,
) -> DataFrame:
    """`left` joined with `right` on one key; `how` is left, inner or left_semi.

    A right side that is `known_large` is not counted; only what Spark itself
    measures while running can turn it into a broadcast.
    `hot_in` names the frame whose rows tell which keys are hot; by default left.
    """
    if not known_large and is_small(right):
        return left.join(F.broadcast(right), key, how)
    hot = hot_keys(left if hot_in is None else hot_in, key)
    if not hot:
        return left.join(right, key, how)
    return _salted(left, right, key, how, hot)


def _salted(left: DataFrame, right: DataFrame, key: str, how: str, hot: list) -> DataFrame:
    owned = _SPREAD not in left.columns
    if owned:  # rows can only be numbered safely where they are scanned
        left = spread_rows(materialize(left, "before-salting"))
    kind = left.schema[key].dataType.simpleString()
    salts = F.broadcast(  # at most 1/HOT_SHARE rows
        left.sparkSession.createDataFrame(hot, f"_hot {kind}, _salts int")
    )
    salted_left = (
        left.join(salts, left[key].eqNullSafe(salts["_hot"]), "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), 0)
                    .otherwise(F.pmod(F.col(_SPREAD), F.col("_salts"))).cast("int"))
        .drop("_hot", "_salts")
    )
    salted_right = (
        right.join(salts, right[key] == salts["_hot"], "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_hot", "_salts")
    )
    joined = salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
    return joined.drop(_SPREAD) if owned else joined

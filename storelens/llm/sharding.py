"""A uniform shuffle into shards of exact sizes, in built-in functions only.

Where each row goes is decided in two steps instead of by one sort of everything. First the communication matrix is
drawn: how many rows of each source partition go to each shard. For a uniform shuffle these counts follow the
multivariate hypergeometric distribution with the partitions' sizes and the shards' sizes as margins, so every
shard gets exactly its size. Then every partition permutes its rows and deals them out by its counts, the rows
are exchanged once, and every shard permutes what it got.

Partitions are those the rows are read in: their sizes are bounded by how Spark splits files, whatever a key or
a group of copies holds. The matrix is drawn down a tree of FAN children a node, so no task and no driver
loops over all partitions. Inside a shard the second permutation sorts by a random key in buckets
of about BUCKET_ROWS rows, each with its own range of slots, so no shard is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.skew import left_join
from storelens.llm.common import let, uniform
from storelens.session import materialize

FAN = 64
BUCKET_ROWS = 10_000
_POSITION_BITS = 33  # width of the row number inside monotonically_increasing_id


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items, out of `total` with `good` among them, are good: the quantile at u in [0, 1).

    The weights of all counts follow from one another by a rational factor; they are summed once and walked
    through again up to the share u. Counts further than 13 deviations and 40 from the mode weigh less than the
    53 bits of u can tell and are left out, so the work grows with the root of `drawn`.
    """

    def bounds(a: Column) -> Column:
        n, k, d = (a[c].cast("double") for c in ("total", "good", "drawn"))
        mode = F.floor((d + 1) * (k + 1) / (n + 2))
        spread = F.sqrt(d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)))
        wide = F.ceil(F.lit(13.0) * spread) + 40
        low = F.greatest(F.lit(0).cast("bigint"), a["drawn"] - (a["total"] - a["good"]))
        high = F.least(a["drawn"], a["good"])
        return F.struct(
            a["total"].alias("total"), a["good"].alias("good"), a["drawn"].alias("drawn"), a["u"].alias("u"),
            F.least(high, F.greatest(low, mode - wide)).alias("low"),
            F.greatest(low, F.least(high, mode + wide)).alias("high"),
        )

    def factor(a: Column, k: Column) -> Column:
        """The weight of k + 1 over that of k."""
        more = (a["good"] - k).cast("double") * (a["drawn"] - k).cast("double")
        less = (k + 1).cast("double") * (a["total"] - a["good"] - a["drawn"] + k + 1).cast("double")
        return more / less

    def quantile(a: Column) -> Column:
        counts = F.sequence(a["low"], a["high"])
        whole = F.aggregate(
            counts, F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum")),
            lambda s, k: F.struct(
                F.when(k < a["high"], s["weight"] * factor(a, k)).otherwise(0.0).alias("weight"),
                (s["sum"] + s["weight"]).alias("sum")),
            lambda s: s["sum"],
        )
        return let(a["u"] * whole, lambda wanted: F.aggregate(
            counts,
            F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), a["low"].alias("k")),
            lambda s, k: F.struct(
                F.when(k < a["high"], s["weight"] * factor(a, k)).otherwise(0.0).alias("weight"),
                (s["sum"] + s["weight"]).alias("sum"),
                F.when((s["sum"] + s["weight"] <= wanted) & (k < a["high"]), k + 1)
                .otherwise(s["k"]).alias("k")),
            lambda s: s["k"],
        ))

    given = F.struct(
        total.cast("bigint").alias("total"), good.cast("bigint").alias("good"),
        drawn.cast("bigint").alias("drawn"), u.alias("u"))
    # nothing to choose from: all or none are good
    return let(given, lambda g: F.when(
        (g["good"] == 0) | (g["drawn"] == 0), F.lit(0).cast("bigint"))
        .when(g["good"] == g["total"], g["drawn"]).when(g["drawn"] == g["total"], g["good"])
        .otherwise(let(bounds(g), quantile)))


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _dealt(left: Column, n: Column, *name: Column) -> Column:
    """How many of n rows go to each shard with `left` places; one hypergeometric draw a shard."""
    start = F.struct(
        n.alias("todo"), F.aggregate(left, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("rest"),
        F.array().cast("array<bigint>").alias("counts"))
    return F.aggregate(
        F.sequence(F.lit(0), F.size(left) - 1), start,
        lambda s, j: let(
            hypergeometric(s["rest"], F.get(left, j), s["todo"], uniform(*name, j)),
            lambda x: F.struct(
                (s["todo"] - x).alias("todo"), (s["rest"] - F.get(left, j)).alias("rest"),
                F.concat(s["counts"], F.array(x)).alias("counts"))),
        lambda s: s["counts"],
    )


def _children_dealt(level: int, seed: int) -> Column:
    """node, n and counts of every child of a node (left: its counts, children: its nodes in order)."""
    kind = "array<struct<node:bigint,n:bigint,counts:array<bigint>>>"
    return F.aggregate(
        "children", F.struct(F.col("left"), F.array().cast(kind).alias("done")),
        lambda s, child: let(
            _dealt(s["left"], child["n"], F.lit(seed), F.lit(level), child["node"]),
            lambda counts: F.struct(
                F.zip_with(s["left"], counts, lambda a, b: a - b).alias("left"),
                F.concat(s["done"], F.array(F.struct(
                    child["node"].alias("node"), child["n"].alias("n"), counts.alias("counts")))).alias("done"))),
        lambda s: s["done"],
    )


def communication_matrix(parts: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """node, n and counts (how many of its rows go to each shard) for every row (node, n) of parts.

    Nodes are numbers from 0; those that lack rows may be missing. The n must add up to the sizes. Every draw
    depends on seed, level, node and shard alone. Empty parts: no rows.
    """
    parts = parts.select(F.col("node").cast("bigint").alias("node"), F.col("n").cast("bigint").alias("n"))
    levels = [parts]
    number = parts.agg(F.max("node")).first()[0]
    while number:
        above = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.sum("n").alias("n"))
        levels.append(above)
        number //= FAN
    top = F.array(*[F.lit(s).cast("bigint") for s in sizes])
    drawn = levels[-1].select("node", "n", top.alias("counts"))
    for level in range(len(levels) - 2, -1, -1):
        grouped = levels[level].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("node"), F.col("n")))).alias("children"))  # FAN at most
        drawn = (
            grouped.join(drawn.select("node", F.col("counts").alias("left")), "node")
            .select(F.inline(_children_dealt(level, seed)))
        )
    return drawn


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """_row (all columns of a row), shard (from 0) and slot (from 0, gapless in its shard) of every row of docs.

    Every assignment of rows to shards of sizes at most one apart, and every order in them, is equally likely, up
    to the 53 bits of a draw. Rows are told apart by where they are read, so nulls, ties, equal rows and the size of a group
    of copies play no part; a run over the same files with the same settings gives the same result. Names of
    columns may be any. With fewer rows than shards the last shards are empty. Empty table: no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # each partition in random order, and frozen: a retried task must not deal its rows anew
    rows = materialize(
        whole.withColumn("_key", F.rand(seed)).sortWithinPartitions("_key").drop("_key")
        .withColumn("_at", F.monotonically_increasing_id()), "shards-rows")
    node = F.shiftright("_at", _POSITION_BITS).alias("node")
    parts = materialize(rows.groupBy(node).agg(F.count(F.lit(1)).alias("n")), "shards-parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    ends = F.aggregate(
        "counts", F.array().cast("array<bigint>"),
        lambda s, x: F.concat(s, F.array(x + F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)))))
    matrix = materialize(
        communication_matrix(parts, shard_sizes(total, shards), seed).select("node", ends.alias("ends")),
        "shards-matrix")

    place = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    shard = F.size(F.filter("ends", lambda e: e <= place))
    sent = left_join(rows.withColumn("node", node), matrix, "node", "inner").select(
        "_row", "_at", shard.alias("shard"), uniform(F.lit(seed), F.lit("again"), "_at").alias("_key"))
    bucket = F.col("shard") * F.lit(buckets) + F.floor(F.col("_key") * buckets)
    sent = sent.withColumn("_bucket", bucket.cast("bigint"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sent.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")), "shards-offsets")
    inside = Window.partitionBy("_bucket").orderBy("_key", "_at")
    numbered = sent.select(
        "_row", "shard", "_bucket", (F.row_number().over(inside) - 1).cast("bigint").alias("_inside"))
    return left_join(numbered, offsets, "_bucket", "inner", hot_in=sent.select("_bucket")).select(
        "_row", "shard", (F.col("_before") + F.col("_inside")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 0) -> None:
    """The shuffled rows as Parquet under path, a folder a shard; files hold slot beside each row."""
    shuffled(docs, shards, seed).write.partitionBy("shard").parquet(path)

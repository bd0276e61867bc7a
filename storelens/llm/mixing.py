"""Mixing sources to target weights by pivotal dependent rounding, in built-in functions only.

Every source gets a target number of words. Its documents are to be copied target / size times,
a number between 0 and `cap`; the whole part is taken, and of the fractions one must draw. Drawn
independently, the total would miss the target by the square root of the number of documents.
Here they are drawn in pairs: of two fractional documents, words move at random from one to the
other (each document's expected copies stay what they were) until one of them is whole. A chain
of pairs leaves one fractional document; the chains' residuals form the next level of a reduction
tree, and the last residual of each source is drawn alone. A source thus misses its target by less
than the words of one document.

Each level groups the fractional documents into chunks by a hash of their id, about CHUNK to a
chunk, so no group grows with the data or with a source's share of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.ranking import global_rank
from storelens.functions.skew import left_join
from storelens.llm.common import WORD, uniform
from storelens.session import materialize

CHUNK = 64
_WHOLE = 1e-9  # a fraction nearer to 0 or 1 than this counts as whole


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0
) -> DataFrame:
    """source, source_size, target for each row (source, source_size) of sizes.

    Sources in code-point order, null last, get the weights in turn and share `share` of all words
    by weight. A target above `cap` times its source is cut to that and the excess goes to the
    others by weight, until none is above. Each round of that is one sum over the sources.
    """
    if share > cap:
        raise ValueError("the sources together cannot give more than cap times their size")
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "rank", "mix-sources")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    weighed = materialize(ranked.select("source", "source_size", weight.alias("weight")), "mix-weights")
    full = F.lit(float(cap)) * F.col("source_size")
    first = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = share * (first["size"] or 0)
    level, capped = total / first["weight"] if first["weight"] else 0.0, 0
    while True:
        above = F.col("weight") * level > full
        now = weighed.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, full)).alias("full"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if now["n"] == capped or not now["weight"]:
            break
        level, capped = (total - now["full"]) / now["weight"], now["n"]
    return weighed.select(
        "source", "source_size", F.least(F.col("weight") * level, full).alias("target")
    )


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _pair(seen: Column, item: Column, draw: Column) -> Column:
    """The state after `item` met the pending document of `seen`.

    State: pending (null or a struct with weight and fraction) and done (those decided).
    """

    def decided(doc: Column, bit: Column) -> Column:
        return F.struct(
            doc["doc_id"].alias("doc_id"), doc["size"].alias("size"), doc["n"].alias("n"),
            (doc["whole"] + bit).cast("int").alias("copies"),
        )

    def snapped(x: Column) -> Column:
        return F.when(x < _WHOLE, 0.0).when(x > 1 - _WHOLE, 1.0).otherwise(x)

    def moved(m: Column) -> Column:
        a, b, ratio = m["a"], m["b"], m["ratio"]
        up = F.least(1 - a["x"], ratio * b["x"])
        down = F.least(a["x"], ratio * (1 - b["x"]))
        return _let(
            F.struct(up.alias("up"), down.alias("down")),
            lambda d: _let(
                F.when(
                    m["u"] * (d["up"] + d["down"]) < d["down"],
                    F.struct(snapped(a["x"] + d["up"]).alias("a"),
                             snapped(b["x"] - d["up"] / ratio).alias("b")),
                ).otherwise(
                    F.struct(snapped(a["x"] - d["down"]).alias("a"),
                             snapped(b["x"] + d["down"] / ratio).alias("b"))
                ),
                lambda x: settle(a, b, x),
            ),
        )

    def settle(a: Column, b: Column, x: Column) -> Column:
        a_done = x["a"].isin(0.0, 1.0)
        b_done = x["b"].isin(0.0, 1.0)
        return F.struct(
            F.when(~a_done, a.withField("x", x["a"])).when(~b_done, b.withField("x", x["b"]))
            .alias("pending"),
            F.filter(
                F.array(F.when(a_done, decided(a, x["a"])), F.when(b_done, decided(b, x["b"]))),
                lambda d: d.isNotNull(),
            ).alias("new"),
        )

    met = _let(
        F.struct(seen["pending"].alias("a"), item.alias("b"),
                 (item["weight"] / seen["pending"]["weight"]).alias("ratio"), draw.alias("u")),
        moved,
    )
    return F.when(
        seen["pending"].isNull(), F.struct(item.alias("pending"), seen["done"].alias("done"))
    ).otherwise(
        _let(met, lambda r: F.struct(
            r["pending"].alias("pending"), F.concat(seen["done"], r["new"]).alias("done")
        ))
    )


_DOC = "doc_id {id}, size bigint, n bigint, whole double, weight double, x double"


def _chained(level: DataFrame, number: int, seed: int, id_type: str) -> DataFrame:
    """One chain over each chunk: source, chunks, its decided documents and the pending one."""
    fields = ["doc_id", "size", "n", "whole", "weight", "x"]
    pending = f"struct<{_DOC.format(id=id_type).replace(' ', ':').replace(',:', ',')}>"
    done = f"array<struct<doc_id:{id_type},size:bigint,n:bigint,copies:int>>"
    start = F.struct(
        F.lit(None).cast(pending).alias("pending"), F.array().cast(done).alias("done")
    )
    order = F.xxhash64("doc_id", "size", F.lit(seed), F.lit(number))
    docs = F.array_sort(F.collect_list(F.struct(order.alias("at"), *fields)))
    folded = F.aggregate(
        docs, start,
        lambda seen, item: _pair(
            seen, F.struct(*[item[f].alias(f) for f in fields]),
            uniform(item["doc_id"], item["size"], F.lit(seed + 1), F.lit(number)),
        ),
    )
    return (
        level.groupBy("key", "chunk", "chunks").agg(folded.alias("end"))
        .select("key", "chunk", "chunks", "end.pending", "end.done")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    cap: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken (size * copies) for every row.

    Copies differ by less than one from target / source_size, so none exceeds `cap`. The draws
    are hashes of ids: reruns agree, on any cluster. Null text: size 0. A document without words takes the
    whole part of its source's ratio. Null sources are one source, null ids are allowed. Rows equal in id,
    source and size share one decision, as one document of their summed size. Empty table: no rows. Other columns
    are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = F.col(source_col).cast("string")
    sized = docs.select(
        F.col(id_col).alias("doc_id"), source.alias("source"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("key"),
        word_count(F.col(text_col)).alias("size"),
    )
    # the texts are read once; what follows works on these narrow rows
    items = materialize(
        sized.groupBy("key", "source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "mix-items"
    )
    per_source = materialize(
        items.groupBy("key", "source").agg(
            F.sum(F.col("size") * F.col("n")).alias("source_size"),
            F.count(F.lit(1)).alias("items"),
        ), "mix-sizes",
    )
    targets = source_targets(per_source.select("source", "source_size"), weights, share, cap)
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = materialize(
        targets.withColumn("key", key).withColumn("ratio", ratio)
        .join(per_source.select("key", "items"), "key"), "mix-targets",
    )
    largest = per_source.agg(F.max("items")).first()[0] or 0

    level = left_join(items.drop("source"), sources.select("key", "ratio", "items"), "key", "inner")
    part = F.col("ratio") - F.floor("ratio")
    near_one = part > 1 - _WHOLE
    level = level.select(
        "key", "doc_id", "size", "n", "items",
        (F.floor("ratio") + F.when(near_one, 1).otherwise(0)).cast("double").alias("whole"),
        (F.col("size") * F.col("n")).cast("double").alias("weight"),
        F.when((part < _WHOLE) | near_one, 0.0).otherwise(part).alias("x"),
    )
    settled = (F.col("x") == 0) | (F.col("weight") == 0)
    out = ["key", "doc_id", "size", "n", "copies"]
    decided = [level.where(settled).withColumn("copies", F.col("whole").cast("int")).select(out)]
    level, count = level.where(~settled), F.col("items")
    number = 0
    while largest > 0:
        level = level.withColumn("chunks", F.ceil(count / CHUNK).cast("bigint"))
        level = level.withColumn(
            "chunk", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 2), F.lit(number)), F.col("chunks"))
        )
        folded = materialize(_chained(level, number, seed, id_type), f"mix-level{number}")
        decided.append(
            folded.select("key", F.explode("done").alias("d"))
            .select("key", "d.doc_id", "d.size", "d.n", "d.copies")
        )
        left = folded.where(F.col("pending").isNotNull())
        level, count = left.select("key", "chunks", "pending.*"), F.col("chunks")
        number += 1
        if largest <= CHUNK:  # one chunk for each source, so at most one document is left of each
            break
        largest = math.ceil(largest / CHUNK)
    if number:
        bit = (uniform("doc_id", "size", F.lit(seed + 3)) < F.col("x")).cast("double")
        decided.append(level.select(
            "key", "doc_id", "size", "n", (F.col("whole") + bit).cast("int").alias("copies")))
    all_decided = decided[0]
    for more in decided[1:]:
        all_decided = all_decided.unionByName(more)
    each = all_decided.withColumn("_row", F.explode(F.sequence(F.lit(1), "n"))).drop("_row", "n")
    return left_join(
        each, sources.select("key", "source", "source_size", "target"), "key", "inner", hot_in=items
    ).select(
        F.col("doc_id").alias(id_col), "size", "source", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )

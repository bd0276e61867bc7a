"""Bounded labelled samples for fitting classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import map_batches, texts
from storelens.llm.simhash import mixed, shingle_hashes
from storelens.session import materialize


def without_copies(sample: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The sample without most rows that nearly repeat one of a smaller id.

    Copies share their rare words, and a classifier would take those for what the label means. Two
    texts whose runs of five words agree to a share J have the same least run hash with
    probability J; of rows with equal least hashes under either of two hashes one stays. The sample is
    bounded, so are these groups.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes = [shingle_hashes(t.lower(), 5) for t in texts(batch.column(1))]
        least = [
            pa.array([int(mixed(h, r).min().view("int64")) if len(h) else None for h in hashes],
                     pa.int64()) for r in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *least], ["_id", "_a", "_b"])

    kind = sample.schema[id_col].dataType.simpleString()
    marks = map_batches(
        sample.select(id_col, text_col), run, f"_id {kind}, _a long, _b long")
    for mark in ("_a", "_b"):
        first = Window.partitionBy(mark).orderBy("_id")
        marks = marks.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return sample.join(F.broadcast(marks.select(F.col("_id").alias(id_col))), id_col, "left_semi")


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    target: str,
    learns: Column,
    per_class: int,
    columns: list[str],
    id_col: str = "doc_id",
) -> DataFrame:
    """The `columns` and label (0 or 1) of at most `per_class` documents of each label.

    Only labels whose id `learns` take part; which ones beyond the bound is a hash of the id. Several labels
    of one id: the largest counts. Near copies are then dropped (without_copies). The ids are at most 2 * per_class rows, so they are
    broadcast, and no text is moved but those of the sample, which are written once.
    """
    known = (
        labels.where(F.col(target).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(target).cast("int").alias("_label"))
        .where(learns)
    )
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_label = 1").orderBy(*by_hash).limit(per_class).unionByName(
        known.where("_label = 0").orderBy(*by_hash).limit(per_class))
    picked = docs.select(F.col(id_col).alias("_id"), *[F.col(c) for c in columns if c != id_col])
    sample = picked.join(F.broadcast(chosen), "_id")
    sample = materialize(
        sample.select(F.col("_id").alias(id_col), *[c for c in columns if c != id_col],
                      F.col("_label").alias("label")), "labelled-sample")
    return materialize(without_copies(sample, id_col), "labelled-distinct")

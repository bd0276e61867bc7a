"""The corpus pipeline: documents in, a mixed training set out, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
documents; the last returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import decontamination, mixing, quality_fm, simhash, substring_dedup
from storelens.llm.common import bounded_batches, crc_rest, table
from storelens.session import scratch

KEEP_FROM = 0.7  # quality score from which a document stays


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at KEEP_FROM or more."""
    labels = table(spark, sf_dir, "labels")
    model = quality_fm.fit(docs, labels, crc_rest("_id", 4) != 2)
    return quality_fm.scored_rows(docs, model).where(F.col("score") >= KEEP_FROM).select("_row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: three-word shingles, links of at most three bits.

    The smallest doc_id stays, null before all others; of repeated rows one. Null and empty texts are copies of
    each other. Empty table: no rows.
    """
    bounded_batches(spark)
    return simhash.without_copies(docs, words=3, max_bits=3)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 20 words that start earlier elsewhere; texts left empty go."""
    bounded_batches(spark)
    changed = F.col("n_removed") > 0
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return (
        substring_dedup.stripped_rows(docs).where(~changed | (F.col("kept") != ""))
        .select(*[
            F.when(changed, fresh[c]).otherwise(F.col("_row").getField(c)).alias(c)
            if c in fresh else F.col("_row").getField(c).alias(c)
            for c in docs.columns
        ])
    )


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", of_quality),
    ("SimHash near-dedup", without_near_copies),
    ("substring dedup", without_passages),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: The stages train, draw and search by fingerprints; SQL cannot state them. Tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes Parquet to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

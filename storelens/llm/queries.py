"""The registered queries of the training-data operators, with their parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import (
    ann,
    archives,
    conversations,
    decontamination,
    licenses,
    mixing,
    quality_fm,
    resampling,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)
from storelens.llm.common import crc_rest, table
from storelens.session import scratch

TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc_rest("_id", 3) != 1)
    return toxicity.score_documents(docs, model).select(
        "doc_id", (crc_rest("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER_FILE)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_fm.fit(docs, labels, crc_rest("_id", 4) != 2)
    return quality_fm.score_documents(docs, model).select(
        "doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "archives")
    archives.write_arc(table(spark, sf_dir, "pages"), f"{base}/arc")
    archives.convert(spark, f"{base}/arc", f"{base}/warc", least_bytes=0)
    return archives.page_records(archives.read_warc(spark, f"{base}/warc", with_payload=False))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), everyone=rows)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    return sharding.shuffled(table(spark, sf_dir, "documents"), shards=8).select(
        "_row.doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).select("_row.doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_nearest": op2_nearest,
        "op3_token_counts": op3_token_counts,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_quality": op5_quality,
        "op6_decontamination": op6_decontamination,
        "op7_archives": op7_archives,
        "op8_simhash": op8_simhash,
        "op9_licenses": op9_licenses,
        "op10_mixing": op10_mixing,
        "op11_conversations": op11_conversations,
        "op12_sharding": op12_sharding,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_nearest": ann.NEAREST_SQL,
        "op4_substring_dedup": substring_dedup.REPEATS_SQL,
        "op11_conversations": conversations.REPAIR_SQL,
        "op13_resampling": resampling.RESAMPLE_SQL,
    }

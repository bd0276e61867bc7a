"""Raw CSV files as lazily read tables.

Spark splits a CSV file among tasks only if no value holds a line break. Tables whose values may hold some are read
as lines here and put together again: a line break lies inside a value if the number of quotes before it
is odd. Every split of a file counts its quotes, a running sum over the splits tells with which parity each begins,
and from there every split cuts its own lines into records. What a split begins inside of goes to the
record that an earlier split left open. So one large file is read by as many tasks as it has splits.
"""

from __future__ import annotations

import csv
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.skew import left_join
from storelens.session import materialize
from storelens.sources.schemas import RAW

log = logging.getLogger(__name__)

#: Tables whose values may hold line breaks.
WITH_LINE_BREAKS = ("reviews",)


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]] | None:
    """Column names -> the files under path that begin with them; None if there is no such path.

    One line of each file is read, by the driver; hidden and empty files are left out.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(conf)
    if not system.exists(top):
        return None
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[tuple[str, ...], list[str]] = {}
    for status in sorted(system.listStatus(top), key=lambda s: s.getPath().toString()):
        file, name = status.getPath(), status.getPath().getName()
        if status.isDirectory() or name[0] in "._" or not status.getLen():
            continue
        stream = system.open(file)
        codec = codecs.getCodec(file)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
        line = reader.readLine()
        reader.close()
        names = next(csv.reader([(line or "").removeprefix("﻿")]), [])
        found.setdefault(tuple(names), []).append(file.toString())
    return found


def load_raw(
    spark: SparkSession, folder: str, files: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """name -> table for every CSV present under `folder`; the others are skipped.

    `files` maps a raw table name to its file or directory, by default
    `<name>.csv`. Columns are typed by name, and each part of a directory is read by its own header, so
    parts may have their columns in another order or lack some, which are NULL then. A column
    that the schema does not know is read as text, and a value that cannot be
    parsed becomes NULL. A table without any file that has a header is skipped too.
    """
    paths = {name: f"{name}.csv" for name in RAW} | (files or {})
    tables = {}
    for name, file in paths.items():
        path = f"{folder.rstrip('/')}/{file}"
        headers = _headers(spark, path)
        if not headers:
            log.warning("raw table %s skipped, no file at %s", name, path)
            continue
        known = {field.name: field for field in RAW[name]}
        read = quoted_records if name in WITH_LINE_BREAKS else _records
        table = None
        for names, parts in headers.items():
            schema = T.StructType([known.get(n, T.StructField(n, T.StringType(), True)) for n in names])
            part = read(spark, parts, schema)
            table = part if table is None else table.unionByName(part, allowMissingColumns=True)
        tables[name] = table
    return tables


def _records(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(
        header=True, enforceSchema=False, mode="PERMISSIVE", escape='"').csv(files)


def quoted_records(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """The records of files of one header, whose values may hold line breaks inside quotes.

    The same rows as a multi-line read of each file as a whole, but every split of a file is a task of its own. Quotes
    inside a value are doubled. A quote that is never closed takes the rest of its file into one value.
    """
    records = materialize(_cut(spark, files), "csv-records")
    whole = _stitched(records).where((F.col("start") != 0) | (F.col("record") != 1))  # without the headers
    options = {"mode": "PERMISSIVE", "escape": '"', "maxCharsPerColumn": "-1"}
    parsed = whole.where(F.trim("text") != "").select(
        F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r")
        if all(f.name.isidentifier() for f in schema)
        else F.from_csv("text", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), options).alias("r"))
    return parsed.select("r.*")


def _cut(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, start (of the split), record and text; record 0 is what the split begins inside of.

    The lines of a split are moved to one task to be numbered in order; a split has a bounded size.
    """
    split = ["file", "start"]
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.translate("value", '"', "")))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(  # a row for each split
        lines.groupBy(*split).agg(F.sum("quotes").alias("quotes"))
        .select(*split, F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before")), "csv-splits")
    name = F.to_json(F.struct(*split)).alias("split")
    placed = left_join(
        lines.withColumn("split", name), before.select(name, "before"), "split", "inner")
    above = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("before") + F.coalesce(F.sum("quotes").over(above), F.lit(0))) % 2
    return (
        placed.withColumn("begins", 1 - inside)
        .withColumn("record", F.sum("begins").over(so_far))
        .groupBy(*split, "record")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("lines"))  # of one record
        .select(*split, "record", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))
    )


def _stitched(records: DataFrame) -> DataFrame:
    """Whole records: what splits begin inside of is appended to the last record begun before."""
    splits = records.groupBy("file", "start").agg(F.max("record").alias("last"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("last") > 0, F.struct(F.col("start").alias("start"), F.col("last").alias("record")))
    owners = splits.select("file", "start", F.last(begun, ignorenulls=True).over(earlier).alias("owner"))
    heads = records.where("record = 0").join(owners, ["file", "start"]).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))  # of one record
    place = F.to_json(F.struct("file", "start", "record")).alias("place")
    rests = heads.select("file", "owner.*", F.array_join(
        F.transform("parts", lambda p: p["text"]), "\n").alias("rest")).select(place, "rest")
    whole = left_join(records.where("record > 0").withColumn("place", place), rests, "place")
    return whole.select("file", "start", "record", F.concat_ws("\n", "text", "rest").alias("text"))

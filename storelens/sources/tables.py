"""Writing, listing and looking into the stored tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import ParseException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_tables(
    tables: dict[str, DataFrame],
    folder: str,
    partition_by: dict[str, list[str]] | None = None,
    sort_by: dict[str, list[str]] | None = None,
) -> None:
    """Replace every table under `folder`.

    A table that is looked up by a key can be written sorted by it, so that a
    lookup skips all row groups but one.
    """
    for name, df in tables.items():
        if name in (sort_by or {}):
            df = df.orderBy(*sort_by[name])
        writer = df.write.mode("overwrite")
        if name in (partition_by or {}):
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{folder.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Read back what save_tables wrote."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table stored under `folder`, by the name of its subfolder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory())
    return load_tables(spark, folder, [n for n in names if n not in ("models", "artifacts")])


def content(df: DataFrame) -> DataFrame:
    """One row: n_rows, and two sums over a 64-bit hash of each row that do not depend on the order of the rows.

    Tables of the same columns that hold the same rows as often have the same content. A lost, added or changed row
    changes both sums unless 128 bits of hash agree by chance. One pass, and nothing is shuffled but one row a task.
    """
    cells = [c for name in df.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    sums = [F.sum(F.xxhash64(F.lit(part), *cells).cast("decimal(20,0)")).alias(f"hash{part}") for part in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows as often, by their `content`; columns are matched by name, types must agree."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        return False
    return content(a).first() == content(b.select(*[f"`{c}`" for c in a.columns])).first()


def register(tables: dict[str, DataFrame]) -> None:
    """Make the tables visible to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows; on Parquet the counts come from the footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")


def preview(spark: SparkSession, name: str, n: int = 100) -> DataFrame:
    """Any n rows of a registered table; an unknown name is refused, not interpolated."""
    try:
        known = spark.catalog.tableExists(name)
    except ParseException:
        known = False
    if not known:
        raise ValueError(f"no table named {name!r}")
    return spark.table(name).limit(n)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def log_run(
    spark: SparkSession, run_name: str, params: dict, metrics: dict, path: str
) -> None:
    """Append one run to the table at `path`."""
    row = (
        run_name,
        dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
        {k: str(v) for k, v in params.items()},
        {k: float(v) for k, v in metrics.items()},
    )
    schema = (
        "run_name string, logged_at timestamp_ntz, "
        "params map<string,string>, metrics map<string,double>"
    )
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

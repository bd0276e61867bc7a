"""Where intermediate tables go, and the session that scripts and tests use."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


INPUT_A_PARTITION = 4 * 1024**2
JOINED = "8m"  # compressed; a few hundred MB once a task sorts it


def local_session(cores: int | str = "*", name: str = "storelens") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session that names none gets a temporary folder of its own;
    on a cluster that would be a different folder on every machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="storelens-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the application's own part of the shared folder, which close() removes."""
    if spark.sparkContext.applicationId not in _opened:
        _opened.add(spark.sparkContext.applicationId)
        atexit.register(_close_active)
    return f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex}"


_opened: set[str] = set()


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/storelens/{spark.sparkContext.applicationId}"


def close(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; results read from them end with it.

    Called by itself when the interpreter ends and the session is still there.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _opened.discard(spark.sparkContext.applicationId)


def _close_active() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext.applicationId in _opened:
        try:
            close(spark)
        except Exception:  # noqa: BLE001 - the session ended first, and cannot delete any more
            pass


def fit_shuffles(spark: SparkSession, frames: Iterable[DataFrame]) -> None:
    """Let shuffles begin with a partition for each INPUT_A_PARTITION bytes of the files behind the frames.

    A fixed number of partitions lets what a task holds grow with the input. Adaptive execution
    joins small ones again, up to JOINED bytes unless the session names another size; a number that is set already
    stays unless it is too low.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for file in {f for df in frames for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if -(-size // INPUT_A_PARTITION) > int(now):
        spark.conf.set(first, str(-(-size // INPUT_A_PARTITION)))
        if spark.conf.get(joined := "spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None:
            spark.conf.set(joined, JOINED)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors: later stages
    read the committed files instead of recomputing, possibly differently, what
    an order-dependent step produced.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

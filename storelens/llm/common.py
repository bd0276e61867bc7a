"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: anything but ASCII white space. bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

CHUNK_BYTES = 4 * 1024**2
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, max_bytes: int | None = None) -> None:
    """Has the session send texts to Python in batches of at most `rows`, unless it already has fewer, and of about
    `max_bytes` where that is given.

    The default of 10,000 rows is meant for numbers; of texts it can be 100 MB and more, held
    several times over in every worker and its executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    if max_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", max_bytes)


def released() -> None:
    """Gives back what a task's Python worker has freed: Spark keeps the worker, and it would keep the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc has it
        trim(0)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`function` over every Arrow batch of df; its batches are the result."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive items of about `most` bytes; a larger item stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
         for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the given columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def crc_rest(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


class Learned(dict):
    """A dict that computes a missing key and forgets all learned ones when it grows too large.

    Only memory and time depend on `most`, never a value.
    """

    def __init__(self, compute: Callable, fixed: dict | None = None, most: int = 150_000):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.limit = compute, fixed or {}, most + len(fixed or {})

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
            self.update(self.fixed)
        value = self[key] = self.compute(key)
        return value

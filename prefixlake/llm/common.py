"""Helpers the operators share: inputs, stored intermediates, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.session import checkpoint_folder

#: Rows of an Arrow batch: texts may be long, so a batch must hold few of them.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and partitions that adaptive execution does not merge too far."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Later steps start from the table: a lost executor costs nothing, values that depend on
    the order of rows are fixed, and only the columns a step asks for are read.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_TABLES: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Delete the tables stored so far by this application.

    Only for a job whose steps write their results and read them again: what is still to be
    worked out from a stored table must not be used afterwards.
    """
    for path in _TABLES.pop(spark.sparkContext.applicationId, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def crc_slice(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def spread(df: DataFrame, per_core: int = 2) -> int:
    """How many partitions keep every core busy."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism * per_core)


def strings(batch: pa.RecordBatch, column: int | str) -> list[str | None]:
    return batch.column(column).to_pylist()


def chunks_of(items: list, sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``items`` whose sizes add up to about ``limit`` (one item at least)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(items):
        yield start, len(items)

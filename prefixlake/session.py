"""Session set-up and the few run-time guards every job shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "prefixlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for a local session without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-prefixlake-")
    context.setCheckpointDir(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which the driver and all executors see."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def hold(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches reuse, and cut its lineage.

    The copy is on shared storage, so a lost executor costs nothing, and later plans start
    from a leaf instead of repeating the whole tree in every branch.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """As :func:`hold`, as a Parquet table: of wide rows, later steps read the columns they use."""
    path = work_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A held table of narrow rows, to be sent to all tasks where it has at most ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hold_all(*builders: Callable[[], DataFrame]) -> list[DataFrame]:
    """As :func:`hold` for independent intermediates, built, planned and run side by side."""
    return side_by_side(*[lambda build=build: hold(build()) for build in builders])


def side_by_side(*builders: Callable[[], object]) -> list:
    """Results of independent builders; small steps are mostly planned, and plans of one do not wait for those of another."""
    with ThreadPoolExecutor(max_workers=len(builders)) as pool:
        return list(pool.map(lambda build: build(), builders))


def tune(spark: SparkSession) -> SparkSession:
    """Let adaptive execution keep small but CPU-heavy partitions apart."""
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    if spark.conf.get(key, "1048576b").lower() in ("1048576b", "1mb", "1m"):
        spark.conf.set(key, "32k")
    return spark

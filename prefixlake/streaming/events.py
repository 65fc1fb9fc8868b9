"""Streams of selection events: ingestion, live profiles, alias upserts, suggestions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from prefixlake.functions.text import normalize_text
from prefixlake.operators.aliases import MEMORY, empty_memory, upsert_aliases
from prefixlake.operators.behavior import TERM_FIELDS

RING = 120


def ingest_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events that are valid to a table, one folder per batch.

    Events lacking an id, a user or a type are left out. A replayed batch overwrites its own folder, so the table holds every event once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        needed = [c for c in ("event_id", "ingest_seq", "user_id", "event_type") if c in batch.columns]
        batch.dropna(subset=needed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(events: DataFrame, n: int = 5000) -> DataFrame:
    """The latest ``n`` events overall, by arrival.

    Every partition keeps its latest ``n``; 64 partitions merge into one heap, 64 heaps into the
    next, and the last merge sees the heaps that are left, so no task reads more than 64 times
    ``n`` rows up to 262,144 partitions.
    """
    rows = events.withColumn("__part", F.spark_partition_id())
    for width in (64, 64 * 64, 64 * 64 * 64):
        heap = W.partitionBy(F.floor(F.col("__part") / width)).orderBy(F.desc("ingest_seq"))
        rows = rows.withColumn("__rank", F.row_number().over(heap)).filter(F.col("__rank") <= n).drop("__rank")
    last = W.partitionBy(F.lit(0)).orderBy(F.desc("ingest_seq"))
    return rows.withColumn("__rank", F.row_number().over(last)).filter(F.col("__rank") <= n).drop("__rank", "__part")


def latest_events(events: DataFrame, n: int = 120) -> DataFrame:
    """The latest ``n`` events of each user with ``user_rank``, 1 the newest; rows without a user are left out."""
    newest = W.partitionBy("user_id").orderBy(F.desc("ingest_seq"))
    return events.filter(F.col("user_id").isNotNull()).withColumn("user_rank", F.row_number().over(newest)).filter(F.col("user_rank") <= n)


def _drop_version(spark: SparkSession, path: str, version: int) -> None:
    """Delete a written version that no replay can need."""
    if version >= 0:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={version}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def retain_events(stream: DataFrame, path: str, checkpoint: str, n: int = 5000) -> StreamingQuery:
    """Keep the latest ``n`` events of a stream in a table, one written version per batch.

    A batch merges its own latest events with the version before it, so late events find their
    place and a replay rebuilds the same version. The two newest versions stay.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = retained(batch.dropna(subset=["ingest_seq"]), n)
        if batch_id > 0:
            rows = retained(spark.read.schema(batch.schema).parquet(f"{path}/v={batch_id - 1}").unionByName(rows), n)
        rows.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        _drop_version(spark, path, batch_id - 2)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TermProfile(StatefulProcessor):
    """Keeps the latest events of one user and emits the user's decayed term weights."""

    def __init__(self, now_us: int, last_n: int = 80, days: float = 14.0) -> None:
        self.now_us, self.last_n, self.days = now_us, last_n, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "seq bigint, ts_us bigint, terms string")
        self.version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        kept = list(self.ring.get()) if self.ring.exists() else []
        for batch in rows:
            kept += list(batch[["ingest_seq", "ts_us", "terms"]].itertuples(index=False, name=None))
        kept = sorted((int(s), int(t), str(x)) for s, t, x in kept)[-RING:]
        self.ring.put(kept)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        weights: dict[str, float] = {}
        for _, ts_us, terms in kept[-self.last_n:]:
            age = max(0.0, (self.now_us - ts_us) / 86_400_000_000.0)
            for term in terms.split("\u0001"):
                if term:
                    weights[term] = weights.get(term, 0.0) + math.exp(-age / self.days)
        yield pd.DataFrame(
            {"user_key": key[0], "version": version, "last_seq": kept[-1][0] if kept else 0, "term": list(weights), "weight": list(weights.values())}
        )

    def close(self) -> None:
        pass


PROFILE_SCHEMA = "user_key string, version bigint, last_seq bigint, term string, weight double"


def live_profiles(stream: DataFrame, now_us: int, last_n: int = 80) -> DataFrame:
    """Per-user term weights as a stream of updates; the highest ``version`` of a user is current,
    also when a late batch changed what lies below the newest event.

    State is at most ``RING`` events per user, partitioned by user; a hot user costs one ring.
    """
    listed = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in TERM_FIELDS])
    terms = F.filter(F.transform(listed, normalize_text), lambda t: F.length(t) >= 3)
    prepared = stream.select(
        normalize_text(F.col("user_id")).alias("user_key"), "ingest_seq", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("ts_us"),
        F.array_join(terms, "\u0001").alias("terms"),
    )
    return prepared.groupBy("user_key").transformWithStateInPandas(
        TermProfile(now_us, last_n), PROFILE_SCHEMA, outputMode="Update", timeMode="None"
    )


def stream_upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold alias observations into a memory table, one written version per batch.

    Each batch reads the version before it, so a replay rebuilds the same version. The two newest versions stay.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(MEMORY).parquet(f"{path}/v={batch_id - 1}") if batch_id > 0 else empty_memory(spark)
        upsert_aliases(before, batch).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        _drop_version(spark, path, batch_id - 2)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_suggest(stream: DataFrame, model, path: str, checkpoint: str) -> StreamingQuery:
    """Run the suggestion job on every micro-batch of requests."""
    from prefixlake.plans.suggest import suggest

    def answer(batch: DataFrame, batch_id: int) -> None:
        suggest(batch, model).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Records of quoted multi-line text files, cut by many tasks.

A line begins a record if an even number of quotes stands before it in its file. Spark deals a
file out in byte ranges; each range counts its quotes and, for either state at its beginning, the
records that begin in it. Running sums over that table, one row a range, give every range its
state and the number of its first record, so each range is cut by itself. Only the records at the
ends of a range meet again in a second, small shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value, quotes, inside): ``inside`` is 1 after an odd number of quotes in the range."""
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    rows = rows.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    before = W.partitionBy(*RANGE).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, block, state, starts, first, at): state at the beginning, records that begin, their first numbers."""
    rows = lines.groupBy(*RANGE).agg(
        (F.sum("quotes") % 2).alias("odd"), F.sum(1 - F.col("inside")).alias("if_outside"), F.sum("inside").alias("if_inside")
    )
    of_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # one row a byte range, not a record, goes through this window
    of_all = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("state", F.coalesce(F.sum("odd").over(of_file), F.lit(0)) % 2)
    rows = rows.withColumn("starts", F.when(F.col("state") == 0, F.col("if_outside")).otherwise(F.col("if_inside")))
    return rows.select(
        *RANGE, "state", "starts", F.coalesce(F.sum("starts").over(of_file), F.lit(0)).alias("first"), F.coalesce(F.sum("starts").over(of_all), F.lit(0)).alias("at")
    )


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, number, text): ``record`` counts from 0 in its file, ``number`` over all files by path.

    A quote that is never closed takes the rest of its file into one record; files without a
    line have no record; blank lines outside quotes are records with an empty text.
    """
    lines = _lines(spark, path)
    placed = lines.join(_ranges(lines), RANGE)
    start = F.when((F.col("inside") + F.col("state")) % 2 == 0, 1).otherwise(0)
    upto = W.partitionBy(*RANGE).orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = (
        placed.withColumn("own", F.sum(start).over(upto)).groupBy(*RANGE, "own", "starts", "first", "at")
        .agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines"))
        .select(
            *RANGE, (F.col("first") + F.col("own") - 1).alias("record"), (F.col("at") + F.col("own") - 1).alias("number"),
            ((F.col("own") == 0) | (F.col("own") == F.col("starts"))).alias("at_end"), F.array_join("lines.value", "\n").alias("text"),
        )
    )
    name = ["file", "record", "number"]
    ends = pieces.filter("at_end").groupBy(*name).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    both = pieces.filter("not at_end").select(*name, "text").unionByName(ends.select(*name, F.array_join("parts.text", "\n").alias("text")))
    return both.withColumn("text", F.rtrim("text", F.lit("\r")))

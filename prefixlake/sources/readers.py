"""Readers with declared schemas, and the checks that go with them."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlake.rules import INTENT_ALIASES
from prefixlake.session import hold
from prefixlake.sources.records import text_records

POI_COLUMNS = [
    "poi_id", "poi_name", "category", "brand", "address", "city", "latitude", "longitude", "rating", "review_count",
    "popularity_score", "tags",
]
PAIR_COLUMNS = ["suggestion_id", "input_prefix", "suggestion_text", "suggestion_type", "score", "query_frequency"]
ABBREVIATION_COLUMNS = ["abbreviation", "expanded_form", "type"]
POPULAR_COLUMNS = ["query_id", "query_text", "intent_type", "monthly_frequency", "region"]
CASE_COLUMNS = ["case_id", "input_prefix", "expected_suggestion_type", "expected_top_suggestions", "difficulty", "skills_tested"]

EVENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("userId", "query", "selectedText", "selectedType", "brand", "category", "city", "occurredAt")]
)
ENTITY = "struct<kind:string,value:string,source:string,confidence:double>"
ALIAS_SCHEMA = (
    f"rawQuery string, rewrite string, intent string, entities array<{ENTITY}>, scope string, source string, "
    "acceptedCount bigint, rejectedCount bigint, status string, lastSeenAt string"
)


def require_columns(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required column(s): {', '.join(missing)}")
    return df


def clean_cells(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trim header marks and cells, fill missing cells with '', drop blank rows; ``keep`` passes unchanged."""
    named = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    cells = [c for c in named.columns if c not in keep]
    text = named.select(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in cells], *keep)
    return text.filter(F.concat(*[F.col(f"`{c}`") for c in cells]) != "")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted multi-line CSV with a header, every cell as clean text, and ``row_ord``.

    A file is read by as many tasks as it has byte ranges. The first row of each file with a cell
    that is not blank is its header, all files of a folder have the same one; a row may lack cells
    at its end; ``row_ord`` numbers the rows by path and place in the file.
    """
    records = text_records(spark, path).filter(F.regexp_replace("text", "[\\s,\"\ufeff]", "") != "")
    first = hold(records.groupBy("file").agg(F.min("record").alias("head"), F.min_by("text", "record").alias("names")))
    heads = [r["names"] for r in first.select(F.replace("names", F.lit("\ufeff"), F.lit("")).alias("names")).distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError(f"{path} holds files with different headers")
    names = [n.strip() for n in next(csv.reader(heads, skipinitialspace=True), [])]
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"{path} is missing required column(s): {', '.join(missing)}")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), options)
    rows = records.join(first, "file").filter("record > head").select("number", cells.alias("cells"))
    raw = rows.select(*[F.col(f"cells.c{names.index(c)}").alias(c) for c in columns], F.col("number").alias("row_ord"))
    return clean_cells(raw, ("row_ord",))


def strict_cast(df: DataFrame, columns: dict[str, str], key: str, name: str = "rows") -> tuple[DataFrame, DataFrame]:
    """Split into rows whose numbers all parse and a quarantine with one row per bad cell."""
    parsed = {c: F.col(c).try_cast("double") for c in columns}
    finite = {c: p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")) for c, p in parsed.items()}
    fine = F.lit(True)
    for ok in finite.values():
        fine = fine & F.coalesce(ok, F.lit(False))
    good = df.filter(fine).withColumns({c: F.col(c).try_cast("double").cast(kind) for c, kind in columns.items()})
    complaints = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.coalesce(finite[c], F.lit(False)),
                    F.concat(F.lit(f"{name} "), F.col(key), F.lit(f" has invalid numeric {c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))),
                )
                for c in columns
            ]
        )
    )
    bad = df.filter(~fine).select(F.col(key).alias("row_key"), F.explode(complaints).alias("error"))
    return good, bad


def strict(df: DataFrame, columns: dict[str, str], key: str, name: str) -> DataFrame:
    """As :func:`strict_cast`, raising on the first bad cell."""
    good, bad = strict_cast(df, columns, key, name)
    first = bad.limit(1).collect()
    if first:
        raise ValueError(first[0]["error"])
    return good


def check_enum(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Raise when a column holds a value outside the list."""
    odd = df.filter(~F.coalesce(F.col(column).isin(values), F.lit(False))).limit(1).collect()
    if odd:
        raise ValueError(f"Unknown {column}: {odd[0][column]}")
    return df


def split_list(c: Column) -> Column:
    """A ``;``-separated cell as an array: trimmed, empty parts dropped."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def canonical_intent(c: Column) -> Column:
    """Suggestion-type label variants under one name; unknown labels stay."""
    pairs = [F.lit(x) for item in INTENT_ALIASES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, POI_COLUMNS)
    typed = strict(
        raw, {"latitude": "double", "longitude": "double", "rating": "double", "review_count": "bigint", "popularity_score": "bigint"}, "poi_id", path
    )
    return typed.withColumn("tags", split_list(F.col("tags")))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    typed = strict(read_csv(spark, path, PAIR_COLUMNS), {"score": "double", "query_frequency": "bigint"}, "suggestion_id", path)
    return typed.withColumn("suggestion_type", canonical_intent(F.col("suggestion_type")))


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ABBREVIATION_COLUMNS)


def read_popular(spark: SparkSession, path: str) -> DataFrame:
    typed = strict(read_csv(spark, path, POPULAR_COLUMNS), {"monthly_frequency": "bigint"}, "query_id", path)
    return typed.withColumn("intent_type", canonical_intent(F.col("intent_type")))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    raw = check_enum(read_csv(spark, path, CASE_COLUMNS), "difficulty", ["Easy", "Medium", "Hard"])
    return raw.withColumn("expected_top_suggestions", split_list(F.col("expected_top_suggestions")))


def read_events(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Selection events from JSON lines, or whole JSON documents; rows lacking one of the five required fields are dropped."""
    raw = spark.read.schema(EVENT_SCHEMA).option("multiLine", not lines).json(path)
    needed = ["userId", "query", "selectedText", "selectedType", "occurredAt"]
    return raw.dropna(subset=needed).select(
        F.col("userId").alias("user_id"), "query", F.col("selectedText").alias("selected_text"), F.col("selectedType").alias("selected_type"),
        "brand", "category", "city", F.try_to_timestamp("occurredAt").alias("occurred_at"),
    )


def read_alias_memory(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ALIAS_SCHEMA).option("multiLine", True).json(path)
    return (
        raw.dropna().filter(F.col("scope").isin("user", "session", "global-candidate"))
        .filter(F.col("source").isin("agent", "alias-memory", "manual", "evaluation"))
        .filter(F.col("status").isin("candidate", "approved", "rejected"))
        .select(
            F.col("rawQuery").alias("raw_query"), "rewrite", "intent", "entities", "scope", "source", F.col("acceptedCount").alias("accepted_count"),
            F.col("rejectedCount").alias("rejected_count"), "status", F.try_to_timestamp("lastSeenAt").alias("last_seen"),
        )
    )


POINT = "struct<lat:double,lon:double>"
CORRIDOR_SCHEMA = (
    f"knownLocations array<struct<id:string,label:string,coordinates:{POINT},aliases:array<string>>>, "
    f"places array<struct<id:string,label:string,category:string,address:string,coordinates:{POINT},source:string,confidence:double,"
    "openingHours:string,openingHoursVerified:boolean,connectorTypes:array<string>,accessPenaltySeconds:bigint,relatedChargerId:string>>"
)


def read_corridor_places(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(places, locations) of a nested route-corridor file."""
    raw = spark.read.schema(CORRIDOR_SCHEMA).option("multiLine", True).json(path)
    places = raw.select(F.explode("places").alias("p")).select(
        F.col("p.id").alias("poi_id"), "p.label", "p.category", "p.address", F.col("p.coordinates.lat").alias("latitude"),
        F.col("p.coordinates.lon").alias("longitude"), "p.source", "p.confidence", F.col("p.openingHours").alias("opening_hours"),
        F.coalesce("p.openingHoursVerified", F.lit(False)).alias("verified"), F.col("p.connectorTypes").alias("connector_types"),
        F.col("p.accessPenaltySeconds").alias("penalty_s"), F.col("p.relatedChargerId").alias("related_id"),
    )
    locations = raw.select(F.posexplode("knownLocations").alias("priority", "l")).select(
        F.col("l.id").alias("location_id"), "l.label", F.col("l.coordinates.lat").alias("lat"), F.col("l.coordinates.lon").alias("lon"),
        "priority", F.explode("l.aliases").alias("alias"),
    )
    return places, locations

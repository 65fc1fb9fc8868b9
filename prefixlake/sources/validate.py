"""Row validation: every table gains an ``errors`` array, empty for good rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.places import parse_bbox


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _collect(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def _too_long(column: str, limit: int, name: str | None = None) -> Column:
    return F.when(F.length(F.trim(F.col(column))) > limit, F.lit(f"{name or column} must be {limit} characters or fewer"))


def _number(column: str, low: float, high: float, name: str | None = None) -> Column:
    name = name or column
    value = F.col(column).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    span = f"{name} must be between {low:g} and {high:g}"
    return F.when(
        ~_blank(F.col(column)),
        F.when(~F.coalesce(finite, F.lit(False)), F.lit(f"{name} must be a finite number")).when((value < low) | (value > high), F.lit(span)),
    )


def _integer(column: str, low: int, high: int) -> Column:
    value = F.col(column).try_cast("bigint")
    return F.when(
        ~_blank(F.col(column)),
        F.when(~F.col(column).rlike("^[0-9]+$"), F.lit(f"{column} must be an integer")).when(
            value.isNull() | (value < low) | (value > high), F.lit(f"{column} must be between {low} and {high}")
        ),
    )


def _time(column: str) -> Column:
    readable = F.try_to_timestamp(F.trim(F.col(column)))
    return F.when(~_blank(F.col(column)) & readable.isNull(), F.lit(f"{column} must be a valid date-time string"))


def _together(a: str, b: str, text: str) -> Column:
    return F.when(_blank(F.col(a)) != _blank(F.col(b)), F.lit(text))


def validate_requests(raw: DataFrame) -> DataFrame:
    """Suggestion requests as text columns q, city, user_id, limit, lat, lon, now."""
    errors = _collect(
        _too_long("city", 80), _too_long("user_id", 80), _integer("limit", 1, 12), _number("lat", -90, 90), _number("lon", -180, 180, "lng"),
        _too_long("now", 64), _time("now"), F.when(F.length("q") > 160, F.lit("q must be 160 characters or fewer")),
        _together("lat", "lon", "lat and lng must be provided together"),
    )
    return raw.withColumn("errors", errors)


def validate_search_requests(raw: DataFrame) -> DataFrame:
    """Search requests: the above with radius, box, language and session."""
    no_point = _blank(F.col("lat")) | _blank(F.col("lon"))
    errors = _collect(
        _number("lat", -90, 90), _number("lon", -180, 180), _number("radius_m", 1, 50000, "radiusMeters"), _integer("limit", 1, 20), _time("now"),
        F.when(_blank(F.col("q")), F.lit("q is required")), F.when(F.length(F.trim("q")) > 160, F.lit("q must be 160 characters or fewer")),
        _together("lat", "lon", "lat and lon must be provided together"),
        F.when(~_blank(F.col("radius_m")) & no_point, F.lit("radiusMeters requires lat and lon")),
        F.when(~_blank(F.col("bbox")) & parse_bbox(F.trim("bbox")).isNull(), F.lit("bbox must use minLon,minLat,maxLon,maxLat")),
        _too_long("lang", 16), _too_long("session_id", 80, "sessionId"), _too_long("city", 80), _too_long("user_id", 80, "userId"),
    )
    return raw.withColumn("errors", errors)


def validate_events(raw: DataFrame) -> DataFrame:
    """Selection events; a missing time becomes the ingest time."""
    required = lambda c, n: F.when(_blank(F.col(c)), F.lit(f"{n} is required"))
    errors = _collect(
        required("user_id", "userId"), _too_long("user_id", 80, "userId"), required("query", "query"), _too_long("query", 160),
        required("selected_text", "selectedText"), _too_long("selected_text", 160, "selectedText"), required("selected_type", "selectedType"),
        _too_long("selected_type", 80, "selectedType"), _too_long("brand", 120), _too_long("category", 120), _too_long("city", 80),
        F.when(
            ~_blank(F.col("occurred_at")) & F.try_to_timestamp(F.trim("occurred_at")).isNull(), F.lit("occurredAt must be an ISO date string")
        ),
    )
    stamped = F.when(_blank(F.col("occurred_at")), F.current_timestamp()).otherwise(F.try_to_timestamp(F.trim("occurred_at")))
    return raw.withColumn("errors", errors).withColumn("occurred_at", stamped)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows)."""
    return validated.filter("size(errors) = 0").drop("errors"), validated.filter("size(errors) > 0")

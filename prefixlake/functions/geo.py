"""Distance and opening-time column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefixlake.functions.num import half_up, round3

EARTH_RADIUS_M = 6371000.0
METERS_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(
        lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon),
        F.lit(False),
    )


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    s_lat, s_lon = F.sin(d_lat / 2.0), F.sin(d_lon / 2.0)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(EARTH_RADIUS_M * 2.0) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def distance_locality(meters: Column) -> Column:
    """1 at the spot, falling to 0.25 at fifteen kilometres."""
    bounded = F.least(F.greatest(meters, F.lit(0.0)), F.lit(15000.0))
    return round3(F.lit(0.25) + (F.lit(1.0) - bounded / 15000.0) * 0.75)


def distance_label(meters: Column) -> Column:
    whole_m = F.concat(half_up(meters).cast("bigint").cast("string"), F.lit(" m"))
    one_digit = F.concat(F.format_string("%.1f", meters / 1000.0), F.lit(" km"))
    no_digit = F.concat(half_up(meters / 1000.0).cast("bigint").cast("string"), F.lit(" km"))
    return F.when(meters < 1000, whole_m).when(meters < 10000, one_digit).otherwise(no_digit)


def clock_minutes(iso: Column) -> Column:
    """Minutes of the wall clock as written; a zone suffix does not move it."""
    trimmed = F.trim(iso)
    pattern = "T(\\d{2}):(\\d{2})(?::\\d{2}(?:\\.\\d+)?)?(?:Z|[+-]\\d{2}:?\\d{2})?$"
    literal = trimmed.rlike(pattern)
    minutes = (
        F.regexp_extract(trimmed, pattern, 1).try_cast("int") * 60
        + F.regexp_extract(trimmed, pattern, 2).try_cast("int")
    )
    parsed = F.try_to_timestamp(trimmed)
    return F.when(literal, F.when(minutes < 1440, minutes)).otherwise(
        F.hour(parsed) * 60 + F.minute(parsed)
    )


def _hours(hours: Column) -> tuple[Column, Column, Column]:
    pattern = "^(\\d{2}):(\\d{2})-(\\d{2}):(\\d{2})$"
    part = lambda i: F.regexp_extract(hours, pattern, i).try_cast("int")
    return hours.rlike(pattern), part(1) * 60 + part(2), part(3) * 60 + part(4)


def within_hours(hours: Column, minutes: Column) -> Column:
    """Half-open interval, may wrap midnight; an end of 24:00 or later is open-ended."""
    well_formed, start, end = _hours(hours)
    inside = (
        F.when(end >= 1440, minutes >= start)
        .when(start <= end, (minutes >= start) & (minutes < end))
        .otherwise((minutes >= start) | (minutes < end))
    )
    return F.when(F.coalesce(well_formed, F.lit(False)), inside).otherwise(F.lit(False))


def corridor_open_state(hours: Column, verified: Column, ts: Column) -> Column:
    """Route-stop variant: inclusive end, no wrap, null unless hours are verified."""
    well_formed, start, end = _hours(hours)
    now = F.hour(ts) * 60 + F.minute(ts)
    return (
        F.when(hours.isNull() | (hours == "") | ~F.coalesce(verified, F.lit(False)), F.lit(None).cast("boolean"))
        .when(hours == "00:00-24:00", F.lit(True))
        .when(~well_formed | ts.isNull(), F.lit(None).cast("boolean"))
        .otherwise((now >= start) & (now <= end))
    )


def segment_distance_m(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Metres from a point to a segment on a local flat projection."""
    mean_lat = F.radians((lat1 + lat2 + lat) / 3.0)
    sx, sy = F.lit(111320.0) * F.cos(mean_lat), F.lit(110540.0)
    ax, ay, bx, by, px, py = lon1 * sx, lat1 * sy, lon2 * sx, lat2 * sy, lon * sx, lat * sy
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))
    )
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


# --- grid cells for range joins --------------------------------------------------------


def lat_band(lat: Column, meters: float) -> Column:
    return F.floor(lat / F.lit(meters / METERS_PER_DEGREE)).cast("bigint")


def lon_step(band: Column, meters: float) -> Column:
    """Cell width in degrees for a latitude band: depends on the band only.

    It is the largest longitude gap two points can have within ``meters`` when both lie in
    the band or next to it. Above 85 degrees a band is one single cell, always lossless.
    """
    size = F.lit(meters / METERS_PER_DEGREE)
    edge = F.greatest(F.abs(band * size), F.abs((band + 1) * size)) + size
    ratio = F.lit(math.sin(meters / EARTH_RADIUS_M / 2.0)) / F.cos(F.radians(F.least(edge, F.lit(85.0))))
    wide = F.degrees(2.0 * F.asin(F.least(ratio, F.lit(1.0))))
    return F.when(edge > 85.0, F.lit(360.0)).otherwise(F.greatest(wide, size))


def lon_cell(lon: Column, band: Column, meters: float) -> Column:
    return F.floor((lon + 180.0) / lon_step(band, meters)).cast("bigint")


def lon_cells_around(lon: Column, band: Column, meters: float) -> Column:
    """The cell of ``lon`` in a band with its neighbours, wrapping the date line."""
    step = lon_step(band, meters)
    count = F.greatest(F.floor(F.lit(360.0) / step).cast("bigint") + 1, F.lit(1).cast("bigint"))
    here = lon_cell(lon, band, meters)
    near = F.array(here - 1, here, here + 1)
    # the last cell may be a sliver, so the wrap reaches one cell further on each side
    wrapped = F.concat(
        near,
        F.when(here <= 0, F.array(count - 1, count - 2)).otherwise(F.array().cast("array<bigint>")),
        F.when(here >= count - 2, F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    return F.array_distinct(F.filter(wrapped, lambda c: c >= 0))

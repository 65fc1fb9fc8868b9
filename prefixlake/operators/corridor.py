"""Route corridors: places along a line, detours, amenities, constraint bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefixlake.functions.geo import haversine_m, lat_band, lon_cell, lon_cells_around, segment_distance_m
from prefixlake.functions.num import clamp01, half_up, round3
from prefixlake.functions.text import strip_accents
from prefixlake.operators.blocking import meet_queries
from prefixlake.operators.places import range_pairs
from prefixlake.rules import ROUTE_CAFE, ROUTE_CHARGER, ROUTE_DETOUR, ROUTE_MINUTES, ROUTE_OPEN_NOW

TRAVEL_SPEED = 19.44


def segments(routes: DataFrame) -> DataFrame:
    """Route points (route_id, seq, lat, lon) as consecutive segments."""
    order = W.partitionBy("route_id").orderBy("seq")
    return (
        routes.withColumn("lat2", F.lead("lat").over(order)).withColumn("lon2", F.lead("lon").over(order))
        .filter("lat2 is not null").select("route_id", "seq", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2")
    )


def along_route(routes: DataFrame, places: DataFrame, width: float, k: int = 20) -> DataFrame:
    """Places within ``width`` metres of each route: route_id, poi_id, offset_m, rank.

    A segment is laid out as sample points no further apart than the cell size, so that every
    place in reach shares a grid neighbourhood with one of them; the exact distance decides.
    Places are dealt by their id and meet blocks of routes, so a crowded cell is no task of its own.
    """
    cell = max(width, 1000.0) * 2.0
    s = segments(routes)
    meters = haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    steps = F.greatest(F.lit(1), F.ceil(meters / (cell / 4.0)).cast("int"))
    t = F.col("i") / F.col("steps")
    samples = (
        s.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
        .withColumn("lat", F.col("lat1") + (F.col("lat2") - F.col("lat1")) * t).withColumn("lon", F.col("lon1") + (F.col("lon2") - F.col("lon1")) * t)
    )
    band = lat_band(F.col("lat"), cell)
    cells = (
        samples.select("route_id", "seq", "lat1", "lon1", "lat2", "lon2", "lon", F.explode(F.sequence(band - 1, band + 1)).alias("band"))
        .select("route_id", "seq", "lat1", "lon1", "lat2", "lon2", "band", F.explode(lon_cells_around(F.col("lon"), F.col("band"), cell)).alias("cell"))
        .distinct()
    )
    dealt = places.select("poi_id", "latitude", "longitude").repartition("poi_id")
    target = dealt.withColumn("band", lat_band(F.col("latitude"), cell)).withColumn("cell", lon_cell(F.col("longitude"), F.col("band"), cell))
    offset = segment_distance_m(*[F.col(c) for c in ("latitude", "longitude", "lat1", "lon1", "lat2", "lon2")])
    found = meet_queries(
        cells, "route_id",
        lambda part: target.join(part, ["band", "cell"]).withColumn("offset_m", offset).filter(F.col("offset_m") <= width)
        .groupBy("route_id", "poi_id").agg(F.min("offset_m").alias("offset_m")),
    )
    order = W.partitionBy("route_id").orderBy("poi_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def compare_detours(cands: DataFrame, ends: DataFrame) -> DataFrame:
    """Extra seconds and metres of a stop against the direct way.

    ``cands`` has route_id, poi_id, latitude, longitude, penalty_s; ``ends`` has route_id,
    lat1, lon1, lat2, lon2.
    """
    point = lambda n: (F.col(f"lat{n}"), F.col(f"lon{n}"))
    via = haversine_m(*point(1), F.col("latitude"), F.col("longitude")) + haversine_m(F.col("latitude"), F.col("longitude"), *point(2))
    seconds = lambda m: F.greatest(F.lit(1).cast("bigint"), half_up(m / TRAVEL_SPEED).cast("bigint"))
    whole = lambda m: half_up(m).cast("bigint")
    direct = haversine_m(*point(1), *point(2))
    return cands.join(ends, "route_id").select(
        "route_id", "poi_id",
        F.greatest(F.lit(0).cast("bigint"), seconds(via) + F.coalesce("penalty_s", F.lit(0)) - seconds(direct)).alias("detour_s"),
        F.greatest(F.lit(0).cast("bigint"), whole(via) - whole(direct)).alias("detour_m"),
    )


def nearby_amenities(cands: DataFrame, amenities: DataFrame, radius: float) -> DataFrame:
    """Amenities within ``radius`` of a stop or explicitly linked to it.

    ``cands`` has poi_id, latitude, longitude; ``amenities`` the same plus related_id (nullable).
    """
    points = cands.select(F.col("poi_id").alias("stop_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()
    close = range_pairs(points, amenities.select("poi_id", "latitude", "longitude"), radius).select("stop_id", "poi_id")
    linked = amenities.filter("related_id is not null").select(F.col("related_id").alias("stop_id"), "poi_id").join(
        points.select("stop_id"), "stop_id", "left_semi"
    )
    return close.unionByName(linked).distinct()


def score_bundles(stops: DataFrame) -> DataFrame:
    """Constraint results, eligibility and score of each stop.

    Reads facility, category, detour_s, detour_m, max_detour_min, want_open, open_state, verified,
    n_amenities, want_amenity, confidence and preferred.
    """
    limit = F.col("max_detour_min") * 60
    facility_ok = (F.col("facility") != "ev-charger") | (F.col("category") == "ev-charger")
    detour_ok = F.col("detour_s") <= limit
    open_true = F.coalesce("open_state", F.lit(False))
    hours_ok = ~F.col("want_open") | (open_true & F.col("verified"))
    eligible = facility_ok & detour_ok & hours_ok
    raw = (
        F.lit(0.45) * (1.0 - F.col("detour_s") / F.greatest(F.lit(1), limit)) + 0.2 + F.least(F.lit(0.15), F.col("n_amenities") * 0.15)
        + F.col("confidence") * 0.1 + F.when(F.col("preferred"), 0.1).otherwise(0.0)
    )
    status = lambda name, value: F.struct(F.lit(name).alias("constraint"), value.alias("status"))
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")
    opening = F.when(~F.col("want_open"), "pass").when(~F.col("verified"), "unverified").otherwise(verdict(open_true))
    results = F.array_compact(
        F.array(
            status("facility", verdict(facility_ok)), status("route", F.lit("pass")), status("open-now", opening), status("detour", verdict(detour_ok)),
            F.when(F.col("want_amenity"), status("nearby-amenity", F.when(F.col("n_amenities") > 0, "pass").otherwise("unverified"))),
        )
    )
    order = W.partitionBy("route_id").orderBy(F.desc("score"), "detour_s", "poi_id")
    return stops.withColumn("eligible", eligible).withColumn("score", F.when(eligible, round3(clamp01(raw))).otherwise(0.0)).withColumn(
        "constraints", results
    ).withColumn("rank", F.row_number().over(order))


def gate_bundles(bundles: DataFrame) -> DataFrame:
    """Bundles that pass every hard constraint; unverified opening hours do not."""
    bad = F.exists("constraints", lambda c: (c["status"] == "fail") | ((c["constraint"] == "open-now") & (c["status"] == "unverified")))
    return bundles.filter(F.col("eligible") & ~bad)


def fold(c: Column) -> Column:
    """Lower-cased text without combining marks; the letter đ stays."""
    kept = F.translate(c, "đĐ", "\u0001\u0002")
    return F.translate(F.lower(strip_accents(kept)), "\u0001\u0002", "đđ")


def route_constraints(requests: DataFrame, locations: DataFrame) -> DataFrame:
    """Read route wishes out of request texts (request_id, query).

    ``locations`` (location_id, alias, priority) names destinations; it is a small dictionary and
    meets the texts through the first three letters of the alias.
    """
    text = fold(F.col("query"))
    minutes = F.regexp_extract("text", ROUTE_MINUTES, 1).try_cast("int")
    df = requests.select("request_id", text.alias("text"))
    from prefixlake.functions.text import grams
    from prefixlake.operators.blocking import signature_join

    texts = df.select("text").distinct().withColumn("sigs", grams(F.col("text"), 3))
    names = locations.select("location_id", "priority", fold(F.col("alias")).alias("alias")).filter("length(alias) >= 3").withColumn(
        "sigs", F.array(F.left("alias", F.lit(3)))
    )
    named = signature_join(names, texts).filter(F.contains("text", F.col("alias"))).groupBy("text").agg(
        F.min_by("location_id", "priority").alias("destination")
    )
    open_now = F.col("text").rlike(ROUTE_OPEN_NOW)
    return df.join(named, "text", "left").select(
        "request_id", F.when(F.col("text").rlike(ROUTE_CHARGER), "ev-charger").otherwise("place").alias("facility"),
        open_now.alias("want_open"), F.when(F.col("text").rlike(ROUTE_CAFE), "cafe").alias("amenity"),
        F.coalesce(F.least(F.lit(60), F.greatest(F.lit(1), minutes)), F.lit(10)).alias("max_detour_min"),
        F.when(F.col("text").rlike(ROUTE_DETOUR), "hard").otherwise("soft").alias("detour_importance"), "destination",
    )



"""Registered queries of place search, geography and corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators import corridor as K
from prefixlake.operators import places as J
from prefixlake.operators.behavior import preference_terms
from prefixlake.registry import duck as d
from prefixlake.registry import shared as S
from prefixlake.registry.core import held, inp, query, table

c = F.col
P = d.inputs("requests", "pois")
METERS = f"CAST(floor({d.haversine('r.lat', 'r.lon', 'latitude', 'longitude')} + 0.5) AS BIGINT)"


def _points(spark, sf) -> DataFrame:
    """Every place as a query point (slightly moved)."""
    return inp(spark, sf, "pois").select(c("row_ord").alias("request_id"), (c("latitude") + 0.003).alias("lat"), (c("longitude") - 0.002).alias("lon"))


PTS = P + ["r AS MATERIALIZED (SELECT row_ord AS request_id, latitude + 0.003::DOUBLE AS lat, longitude - 0.002::DOUBLE AS lon FROM in_pois)"]
RANKED = "row_number() OVER (PARTITION BY request_id ORDER BY distance_m, popularity_score DESC, poi_id) AS rank"


@query(
    "j1_nearby",
    d.with_(
        PTS + [f"n AS (SELECT request_id, poi_id, popularity_score, {METERS} AS distance_m FROM r, in_pois p WHERE abs(r.lat - latitude) < 0.5 AND contains({d.norm('(category || chr(32) || array_to_string(tags, chr(32)))')}, 'quan'))", f"k AS (SELECT request_id, poi_id, distance_m, {RANKED} FROM n WHERE distance_m <= 25000)"],
        "SELECT * FROM k WHERE rank <= 10",
    ),
)
def j1(spark, sf):
    return J.nearby(_points(spark, sf), inp(spark, sf, "pois"), 25000.0, "Quán", 10)


@query(
    "j2_reverse_geocode",
    d.with_(PTS + [f"n AS (SELECT request_id, poi_id, popularity_score, {METERS} AS distance_m FROM r, in_pois p)", f"k AS (SELECT request_id, poi_id, distance_m, {RANKED} FROM n)"], "SELECT * FROM k WHERE rank <= 5"),
)
def j2(spark, sf):
    return J.reverse_geocode(_points(spark, sf), inp(spark, sf, "pois"), 5)


GEO_HAY = d.norm("(poi_name || ' ' || address || ' ' || city || ' ' || category || ' ' || brand)")


@query(
    "j3_geocode",
    d.with_(
        P + [
            "a AS (SELECT address, min(row_ord) AS request_id FROM in_pois GROUP BY address)", f"q AS MATERIALIZED (SELECT request_id, {d.norm('address')} AS query FROM a)",
            f"h AS MATERIALIZED (SELECT poi_id, popularity_score, {GEO_HAY} AS hay FROM in_pois)",
            "s AS (SELECT request_id, poi_id, popularity_score, CASE WHEN contains(hay, query) THEN 1.0::DOUBLE ELSE len(list_filter(string_split(query, ' '), lambda t: length(t) >= 2 AND contains(hay, t))) / len(string_split(query, ' '))::DOUBLE END AS raw FROM q, h)",
            "k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY raw DESC, popularity_score DESC, poi_id) AS rank FROM s WHERE raw > 0)",
        ],
        f"SELECT request_id, poi_id, greatest(0.01::DOUBLE, {d.round3('raw')}) AS score, rank FROM k WHERE rank <= 5",
    ),
)
def j3(spark, sf):
    pois = inp(spark, sf, "pois")
    asked = pois.groupBy("address").agg(F.min("row_ord").alias("request_id"))
    return J.geocode(asked, pois, 5)


KEYWORD = d.form_ctes() + d.inputs("pois") + [
    "tm AS MATERIALIZED (SELECT DISTINCT q, t FROM (SELECT q, unnest(list_concat(list_append(string_split(norm, ' '), norm), list_append(string_split(expanded, ' '), expanded))) AS t FROM forms) WHERE length(t) >= 2)",
    f"pf AS MATERIALIZED (SELECT poi_id, popularity_score, {d.norm('poi_name')} AS n, {d.norm('brand')} AS b, {d.norm('category')} AS k, {d.norm('(poi_name || chr(32) || brand || chr(32) || category || chr(32) || address || chr(32) || city || chr(32) || array_to_string(tags, chr(32)))')} AS h FROM in_pois)",
    "ut AS MATERIALIZED (SELECT DISTINCT t FROM tm)",
    "ts AS MATERIALIZED (SELECT t, poi_id, popularity_score, CASE WHEN contains(n, t) THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN contains(b, t) THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN contains(k, t) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN contains(h, t) THEN 0.15::DOUBLE ELSE 0 END AS w FROM ut, pf WHERE contains(h, t))",
    "ks AS MATERIALIZED (SELECT q, poi_id, popularity_score, round(sum(w), 6) AS raw FROM tm JOIN ts USING (t) GROUP BY ALL)",
]


@query("j4_keyword_search", d.with_(KEYWORD, f"SELECT q, poi_id, greatest(popularity_score / 100.0::DOUBLE, {d.round3('raw')}) AS score, row_number() OVER (PARTITION BY q ORDER BY raw DESC, popularity_score DESC, poi_id) AS rank FROM ks"))
def j4(spark, sf):
    return held(spark, sf, "j4", lambda: J.keyword_search(S.forms(spark, sf), inp(spark, sf, "pois")))


# two lists of places per city, as a search would bring them together
LISTS = P + [
    "a AS (SELECT city AS request_id, 'poi:' || poi_id AS id, poi_name AS name, category, CASE WHEN brand <> '' THEN latitude END AS lat, CASE WHEN brand <> '' THEN longitude END AS lon, popularity_score / 100.0::DOUBLE AS score, row_ord AS ord, 0 AS l FROM in_pois WHERE popularity_score >= 65)",
    "b AS (SELECT city AS request_id, 'poi:' || poi_id AS id, poi_name AS name, category, latitude AS lat, longitude AS lon, rating / 5.0::DOUBLE AS score, row_ord AS ord, 1 AS l FROM in_pois WHERE rating >= 3.5)",
    "u AS (SELECT * FROM a UNION ALL SELECT * FROM b)",
    "m AS MATERIALIZED (SELECT request_id, id, arg_max(name, score) AS name, arg_max(category, score) AS category, max(lat) AS lat, max(lon) AS lon, max(score) AS score, min(l * 10000000 + ord) AS first_ord FROM u GROUP BY request_id, id)",
]


def _lists(spark, sf):
    pois = inp(spark, sf, "pois")
    shape = lambda df, lat, lon, score: df.select(
        c("city").alias("request_id"), F.concat(F.lit("poi:"), "poi_id").alias("id"), c("poi_name").alias("name"), "category", lat.alias("lat"), lon.alias("lon"),
        score.alias("score"), c("row_ord").alias("ord"), "address", "tags",
    )
    placed = lambda col: F.when(c("brand") != "", c(col))
    first = shape(pois.filter("popularity_score >= 65"), placed("latitude"), placed("longitude"), c("popularity_score") / 100.0)
    second = shape(pois.filter("rating >= 3.5"), c("latitude"), c("longitude"), c("rating") / 5.0)
    return first, second


def _merged(spark, sf):
    return held(spark, sf, "j5", lambda: J.merge_places(*_lists(spark, sf)))


@query("j5_merge_places", d.with_(LISTS, "SELECT request_id, id, name, lat, lon, score FROM m"))
def j5(spark, sf):
    return _merged(spark, sf).select("request_id", "id", "name", "lat", "lon", "score")


@query("j6_order_search", d.with_(LISTS, f"SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY (lat IS NOT NULL) DESC, contains({d.norm('(name || chr(32) || name || chr(32) || category)')}, 'ca phe') DESC, score DESC, first_ord) AS rank FROM m"))
def j6(spark, sf):
    return J.order_search(_merged(spark, sf).withColumn("norm", F.lit("ca phe"))).select("request_id", "id", "rank")


DM = f"CAST(floor({d.haversine('12.0::DOUBLE', '105.0::DOUBLE', 'lat', 'lon')} / 1 + 0.5) AS BIGINT)"
RESC = LISTS + [f"z AS MATERIALIZED (SELECT *, {DM} AS dm FROM m)", f"y AS MATERIALIZED (SELECT request_id, id, name, category, lat, lon, dm, CASE WHEN dm IS NULL THEN score ELSE least(1.0::DOUBLE, {d.round3('score * 0.72::DOUBLE + greatest(0, 1 - least(dm, 15000) / 15000.0::DOUBLE) * 0.28::DOUBLE + 0.12::DOUBLE')}) END AS score FROM z)"]


def _rescored(spark, sf):
    return J.rescore_proximity(_merged(spark, sf).withColumn("r_lat", F.lit(12.0)).withColumn("r_lon", F.lit(105.0)))


@query("j7_rescore_proximity", d.with_(RESC, "SELECT request_id, id, dm AS distance_m, score FROM y"))
def j7(spark, sf):
    return _rescored(spark, sf).select("request_id", "id", "distance_m", "score")


@query("j8_filter_places", d.with_(RESC, f"SELECT request_id, id FROM y WHERE NOT coalesce(dm > 400000, false) AND NOT coalesce(lon < 103 OR lon > 108 OR lat < 9 OR lat > 20, false) AND contains({d.norm('category')}, 'quan')"))
def j8(spark, sf):
    rows = _rescored(spark, sf).withColumn("radius_m", F.lit(400000.0)).withColumn("bbox", F.lit("103, 9, 108, 20")).withColumn("want_category", F.lit("Quán")).withColumn("type", F.lit("poi"))
    return J.filter_places(rows).select("request_id", "id")


@query("j9_scope_city", d.with_(P, f"SELECT request_id, poi_id FROM in_requests r JOIN in_pois p ON cust = row_ord WHERE r.city IS NULL OR {d.city_key(d.norm('p.city'))} = {d.city_key(d.norm('r.city'))}"))
def j9(spark, sf):
    own = inp(spark, sf, "pois").select(c("row_ord").alias("cust"), "poi_id", "address", c("poi_name").alias("name"))
    return J.scope_city(S.requests(spark, sf).select("request_id", "cust", c("city").alias("want_city")).join(own, "cust")).select("request_id", "poi_id")


@query("j10_lookup_poi", d.with_(P, "SELECT o_orderkey AS request_id, poi_id FROM orders JOIN in_pois ON o_custkey = row_ord"))
def j10(spark, sf):
    asked = table(spark, sf, "orders").select(c("o_orderkey").alias("request_id"), F.concat(F.when(c("o_orderkey") % 2 == 0, "POI:p").otherwise("P"), c("o_custkey").cast("string")).alias("id"))
    return J.lookup_poi(asked, inp(spark, sf, "pois")).select("request_id", "poi_id")


@query("j11_to_places")
def j11(spark, sf):
    """The place rows of every request's suggestions, with all their fields; nested ones as text."""
    from prefixlake.plans.suggest import fan_out

    listed = lambda col: F.array_join(col, ";")
    rows = J.to_places(S.suggested(spark, sf).ranked).select(
        "request_id", "id", "type", "suggestion_type", "name", "label", "address", "category", "brand", "lat", "lon", "score", "source", F.to_json("score_factors").alias("score_factors"),
        listed("tags").alias("tags"), "rating", "review_count", "popularity_score", listed(F.map_keys("enrichment.fields")).alias("fields"),
        listed(F.transform("enrichment.attributes", lambda a: a["key"])).alias("attributes"), listed("enrichment.summary_evidence").alias("summary_evidence"), "ord",
    )
    return fan_out(S.requests(spark, sf).drop("cust"), rows)


@query("j12_search")
def j12(spark, sf):
    """Search of every request over the shared suggestion run, with radius, box and category filters where a request sets them."""
    from prefixlake.plans.search import search_run

    asked = S.requests(spark, sf).drop("cust").withColumns({
        "radius_m": F.when(c("lat").isNotNull() & (c("request_id") % 3 == 0), 60000.0), "bbox": F.when(c("request_id") % 5 == 0, "102,8,107,20"),
        "want_category": F.when(c("request_id") % 7 == 0, "Khách sạn"),
    })
    return search_run(asked, S.suggested(spark, sf), S.catalog(spark, sf).pois, 10).select("request_id", "rank", "id", "name", "score", "distance_m")


ROUTE = "SELECT o_custkey AS route_id, o_orderkey AS seq, 8 + CAST((o_orderkey * 37) % 1500 AS DOUBLE) / 100 AS lat, 102 + CAST((o_orderkey * 53) % 700 AS DOUBLE) / 100 AS lon, CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'bicycle' ELSE 'auto' END AS mode FROM {orders}"


def _routes(spark, sf):
    return spark.sql(ROUTE, orders=table(spark, sf, "orders"))


LEG = [f"rt AS MATERIALIZED ({ROUTE.replace('{orders}', 'orders')})"]


@query(
    "j13_route_legs",
    d.with_(
        LEG + [f"lg AS (SELECT route_id, mode, {d.haversine('plat', 'plon', 'lat', 'lon')} AS m FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM rt WINDOW w AS (PARTITION BY route_id ORDER BY seq)))",
               "s AS (SELECT route_id, mode, count(*) AS n_stops, CAST(floor(coalesce(sum(m), 0) + 0.5) AS BIGINT) AS distance_m FROM lg GROUP BY ALL)"],
        "SELECT route_id, n_stops, distance_m, greatest(1, CAST(floor(distance_m / CASE mode WHEN 'pedestrian' THEN 1.35::DOUBLE WHEN 'bicycle' THEN 4.5::DOUBLE ELSE 8.5::DOUBLE END + 0.5) AS BIGINT)) AS duration_s FROM s",
    ),
)
def j13(spark, sf):
    return J.route_legs(_routes(spark, sf)).select("route_id", "n_stops", "distance_m", "duration_s")


# one corridor per nation: three corners derived from its key
LINE_SQL = "SELECT n_nationkey AS route_id, i AS seq, 9 + CAST((n_nationkey * 7 + i * 5) % 14 AS DOUBLE) AS lat, 102.5 + CAST((n_nationkey * 3 + i * 2) % 6 AS DOUBLE) AS lon FROM {nation} JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) k ON n_nationkey >= 0"


def _lines(spark, sf):
    return spark.sql(LINE_SQL, nation=table(spark, sf, "nation")).select("route_id", "seq", c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon"))


_ml = "radians((lat1 + lat2 + latitude) / 3)"
SEGS = P + [
    f"ln AS MATERIALIZED ({LINE_SQL.replace('{nation}', 'nation')})",
    "sg AS MATERIALIZED (SELECT * FROM (SELECT route_id, seq, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM ln WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE lat2 IS NOT NULL)",
    f"g AS (SELECT route_id, poi_id, lon1 * 111320 * cos({_ml}) AS ax, lat1 * 110540 AS ay, lon2 * 111320 * cos({_ml}) AS bx, lat2 * 110540 AS b_y, longitude * 111320 * cos({_ml}) AS px, latitude * 110540 AS py FROM sg, in_pois)",
    "t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM g)",
    "al AS MATERIALIZED (SELECT route_id, poi_id, min(sqrt((px - ax - t * (bx - ax)) * (px - ax - t * (bx - ax)) + (py - ay - t * (b_y - ay)) * (py - ay - t * (b_y - ay)))) AS offset_m FROM t GROUP BY ALL)",
    "rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY poi_id) AS rank FROM al WHERE offset_m <= 20000)",
]


def _along(spark, sf):
    return held(spark, sf, "j14", lambda: K.along_route(_lines(spark, sf), inp(spark, sf, "pois"), 20000.0, 20))


@query("j14_along_route", d.with_(SEGS, "SELECT route_id, poi_id, round(offset_m, 3) AS offset_m, rank FROM rk WHERE rank <= 20"))
def j14(spark, sf):
    return _along(spark, sf).select("route_id", "poi_id", F.round("offset_m", 3).alias("offset_m"), "rank")


def _ends(spark, sf):
    lines = _lines(spark, sf)
    at = lambda n, col: F.max(F.when(c("seq") == n, c(col)))
    return lines.groupBy("route_id").agg(at(0, "lat").alias("lat1"), at(0, "lon").alias("lon1"), at(2, "lat").alias("lat2"), at(2, "lon").alias("lon2"))


VIA = f"({d.haversine('lat1', 'lon1', 'latitude', 'longitude')} + {d.haversine('latitude', 'longitude', 'lat2', 'lon2')})"
DIRECT = d.haversine("lat1", "lon1", "lat2", "lon2")
SECS = lambda m: f"greatest(1, CAST(floor({m} / 19.44::DOUBLE + 0.5) AS BIGINT))"
DETOUR = SEGS + [
    "en AS (SELECT route_id, max(CASE WHEN seq = 0 THEN lat END) AS lat1, max(CASE WHEN seq = 0 THEN lon END) AS lon1, max(CASE WHEN seq = 2 THEN lat END) AS lat2, max(CASE WHEN seq = 2 THEN lon END) AS lon2 FROM ln GROUP BY route_id)",
    f"dt AS MATERIALIZED (SELECT route_id, poi_id, greatest(0, {SECS(VIA)} + row_ord % 300 - {SECS(DIRECT)}) AS detour_s, greatest(0, CAST(floor({VIA} + 0.5) AS BIGINT) - CAST(floor({DIRECT} + 0.5) AS BIGINT)) AS detour_m FROM rk JOIN in_pois USING (poi_id) JOIN en USING (route_id) WHERE rank <= 20)",
]


def _detours(spark, sf):
    stops = _along(spark, sf).select("route_id", "poi_id").join(inp(spark, sf, "pois").withColumn("penalty_s", c("row_ord") % 300), "poi_id")
    return held(spark, sf, "j15", lambda: K.compare_detours(stops, _ends(spark, sf)))


@query("j15_compare_detours", d.with_(DETOUR, "SELECT * FROM dt"))
def j15(spark, sf):
    return _detours(spark, sf)


@query(
    "j16_nearby_amenities",
    d.with_(P, f"SELECT DISTINCT s.poi_id AS stop_id, a.poi_id FROM in_pois s, in_pois a WHERE s.category = 'Cây xăng' AND a.category = 'Quán cà phê' AND ({d.haversine('s.latitude', 's.longitude', 'a.latitude', 'a.longitude')} <= 30000 OR a.row_ord + 4 = s.row_ord)"),
)
def j16(spark, sf):
    pois = inp(spark, sf, "pois").withColumn("related_id", F.concat(F.lit("P"), (c("row_ord") + 4).cast("string")))
    return K.nearby_amenities(pois.filter("category = 'Cây xăng'"), pois.filter("category = 'Quán cà phê'"), 30000.0)


BUNDLE = DETOUR + [
    "bs AS (SELECT dt.*, category, row_ord, row_ord % 3 <> 0 AS verified, row_ord % 2 = 0 AS open_state, row_ord % 4 AS n_amenities, row_ord % 7 = 0 AS preferred, CAST(row_ord % 10 AS DOUBLE) / 10 AS confidence FROM dt JOIN in_pois USING (poi_id))",
    "bo AS (SELECT *, detour_s <= 36000 AND (open_state AND verified) AS eligible FROM bs)",
    f"sc AS MATERIALIZED (SELECT *, CASE WHEN eligible THEN {d.round3(d.clamp01('0.45::DOUBLE * (1 - detour_s / 36000.0::DOUBLE) + 0.2::DOUBLE + least(0.15::DOUBLE, n_amenities * 0.15::DOUBLE) + confidence * 0.1::DOUBLE + CASE WHEN preferred THEN 0.1::DOUBLE ELSE 0 END'))} ELSE 0.0::DOUBLE END AS score FROM bo)",
]


def _bundles(spark, sf):
    pois = inp(spark, sf, "pois").select("poi_id", "category", "row_ord")
    key = c("row_ord")
    stops = _detours(spark, sf).join(pois, "poi_id").select(
        "*", F.lit("place").alias("facility"), F.lit(600).alias("max_detour_min"), F.lit(True).alias("want_open"), (key % 3 != 0).alias("verified"), (key % 2 == 0).alias("open_state"),
        (key % 4).alias("n_amenities"), F.lit(True).alias("want_amenity"), ((key % 10).cast("double") / 10).alias("confidence"), (key % 7 == 0).alias("preferred"),
    )
    return held(spark, sf, "j17", lambda: K.score_bundles(stops))


@query("j17_score_bundles", d.with_(BUNDLE, "SELECT route_id, poi_id, eligible, score, row_number() OVER (PARTITION BY route_id ORDER BY score DESC, detour_s, poi_id) AS rank FROM sc"))
def j17(spark, sf):
    return _bundles(spark, sf).select("route_id", "poi_id", "eligible", "score", "rank")


WISH = "p_name || CASE p_size % 6 WHEN 0 THEN ' EV charger open now near coffee to Da Nang max 12 minutes' WHEN 1 THEN ' cafe mo cua' WHEN 2 THEN ' sạc xe đi Sài Gòn 90 phut' WHEN 3 THEN ' detour ho chi minh' WHEN 4 THEN ' to danang then hcm' ELSE ' 5 min stop' END"
FOLD = "lower(regexp_replace(replace(replace(strip_accents(replace(replace(w, 'đ', '\u0001'), 'Đ', '\u0002')), '\u0001', 'đ'), '\u0002', 'đ'), '[̀-ͯ]', '', 'g'))"


@query(
    "j18_route_constraints",
    f"WITH t AS (SELECT p_partkey AS request_id, {FOLD} AS x FROM (SELECT p_partkey, {WISH} AS w FROM part)) SELECT request_id, CASE WHEN regexp_matches(x, 'charger|charging|ev|sac') THEN 'ev-charger' ELSE 'place' END AS facility, "
    "regexp_matches(x, 'open now|mo cua') AS want_open, CASE WHEN regexp_matches(x, 'coffee|cafe|ca phe') THEN 'cafe' END AS amenity, "
    "coalesce(least(60, greatest(1, TRY_CAST(nullif(regexp_extract(x, '([0-9]{1,2})\\s*(?:minute|min|minutes|phut)', 1), '') AS INT))), 10) AS max_detour_min, CASE WHEN regexp_matches(x, 'detour|minute|min|phut') THEN 'hard' ELSE 'soft' END AS detour_importance, "
    "CASE WHEN contains(x, 'ho chi minh') OR contains(x, 'sai gon') THEN 'south' WHEN contains(x, 'da nang') OR contains(x, 'danang') THEN 'central' END AS destination FROM t",
)
def j18(spark, sf):
    asked = table(spark, sf, "part").selectExpr("p_partkey AS request_id", f"{WISH} AS query")
    named = spark.createDataFrame([("south", "hồ chí minh", 0), ("south", "sài gòn", 0), ("central", "đà nẵng", 1), ("central", "da nang", 1), ("central", "danang", 1)], "location_id string, alias string, priority int")
    return K.route_constraints(asked, named)


@query(
    "j19_preference_terms",
    d.with_(
        d.inputs("events") + ["r AS (SELECT user_id, ingest_seq, lower(coalesce(brand, '') || ' ' || coalesce(category, '') || ' ' || selected_text) AS line FROM in_events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ingest_seq DESC) <= 20)"],
        "SELECT user_id, string_agg(line, '|' ORDER BY ingest_seq) AS terms FROM r GROUP BY user_id",
    ),
)
def j19(spark, sf):
    return preference_terms(inp(spark, sf, "events")).select("user_id", F.array_join("terms", "|").alias("terms"))


@query("j20_gate_bundles", d.with_(BUNDLE, "SELECT route_id, poi_id FROM sc WHERE eligible"))
def j20(spark, sf):
    return K.gate_bundles(_bundles(spark, sf)).select("route_id", "poi_id")



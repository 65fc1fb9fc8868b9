"""Registered queries over the column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.functions import geo, match, num, text
from prefixlake.operators.cities import behavior_city_key, city_key
from prefixlake.operators.understand import telex_candidates, telex_plain, telex_toneless
from prefixlake.registry import duck as d
from prefixlake.registry.core import inp, query, table

c = F.col
N_TEXT = d.norm("text")


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _doc_query(name: str, column, sql_expr: str, alias: str) -> None:
    @query(name, f"SELECT doc_id, {sql_expr} AS {alias} FROM documents")
    def run(spark, sf) -> DataFrame:
        return _docs(spark, sf).select("doc_id", column().alias(alias))


norm = lambda: text.normalize_text(c("text"))
_doc_query("b1_strip_accents", lambda: text.strip_accents(c("text")), d.unaccent("text"), "folded")
_doc_query("b2_normalize_text", norm, N_TEXT, "norm")
_doc_query("b3_tokenize", lambda: F.array_join(text.tokenize(c("text")), "|"), f"array_to_string({d.dot_words(N_TEXT)}, '|')", "tokens")
_doc_query("b4_phrase_tokens", lambda: F.array_join(text.phrase_tokens(c("text")), "|"), f"array_to_string({d.words(N_TEXT)}, '|')", "tokens")
_doc_query("b5_compact", lambda: text.compact(c("text")), d.flat(N_TEXT), "compact")
_doc_query(
    "b6_contains_token_phrase", lambda: text.contains_token_phrase(norm(), F.lit("of the")), d.has_phrase(N_TEXT, "'of the'"), "hit"
)
_doc_query(
    "b7_replace_token_phrase", lambda: text.replace_token_phrase(norm(), F.lit("the"), F.lit("x y")),
    f"array_to_string(list_transform({d.words(N_TEXT)}, lambda t: CASE WHEN t = 'the' THEN 'x y' ELSE t END), ' ')", "replaced",
)
_doc_query(
    "b17_contains_any", lambda: text.contains_any(c("text"), ["Wh-an", "éaux"]), d.has_any(N_TEXT, ["wh an", "eaux"]), "hit"
)


@query(
    "b29_trigrams",
    f"WITH t AS MATERIALIZED (SELECT doc_id, {d.flat(N_TEXT)} AS x FROM documents), g AS (SELECT doc_id, unnest(string_split(x, '')) AS ch, "
    "generate_subscripts(string_split(x, ''), 1) AS i FROM t), w AS (SELECT doc_id, ch || lead(ch) OVER o || lead(ch, 2) OVER o AS g FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)) "
    "SELECT t.doc_id, coalesce(k, 0) AS n_trigrams FROM t LEFT JOIN (SELECT doc_id, count(DISTINCT g) AS k FROM w GROUP BY doc_id) USING (doc_id)",
)
def b29(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(text.trigrams(c("text"))).cast("bigint").alias("n_trigrams"))


PAIR_SQL = d.inputs("requests", "pois") + [
    f"pr AS MATERIALIZED (SELECT request_id, {d.norm('q')} AS n, {d.norm('poi_name')} AS h, {d.norm('category')} AS cat, poi_name, category, brand, "
    "address, p.city AS city, lat, lon, latitude, longitude, now FROM in_requests JOIN in_pois p ON cust = row_ord)",
    "pq AS MATERIALIZED (SELECT DISTINCT n, h, cat FROM pr)",
]


def _pairs(spark, sf) -> DataFrame:
    """Every request with the place of its own customer."""
    pois = inp(spark, sf, "pois").withColumnRenamed("row_ord", "cust")
    return inp(spark, sf, "requests").drop("city").join(pois, "cust").select(
        "request_id", text.normalize_text(c("q")).alias("n"), text.normalize_text(c("poi_name")).alias("h"),
        text.normalize_text(c("category")).alias("cat"), "q", "poi_name", "category", "brand", "address", "city", "lat", "lon", "latitude", "longitude", "now",
    )


def _pair_query(name: str, columns: dict, sql: dict) -> None:
    chosen = ", ".join(f"{e} AS {a}" for a, e in sql.items())

    @query(name, d.with_(PAIR_SQL, f"SELECT n, h, {chosen} FROM pq"))
    def run(spark, sf) -> DataFrame:
        distinct = _pairs(spark, sf).select("n", "h", "cat").distinct()
        return distinct.select("n", "h", *[build().alias(a) for a, build in columns.items()])




def n():
    return c("n")


def h():
    return c("h")


def cat():
    return c("cat")


def toks():
    return text.dot_words(n())


_pair_query("b8_edit_within", {"near": lambda: match.edit_within(n(), cat(), 6)}, {"near": "levenshtein(n, cat) <= 6"})
_pair_query("b9_fuzzy_includes", {"hit": lambda: match.fuzzy_includes(h(), n())}, {"hit": d.fuzzy("h", "n")})
_pair_query("b10_prefix_phrase_match", {"hit": lambda: match.prefix_phrase_match(h(), n())}, {"hit": d.prefix_phrase("h", "n")})
_pair_query("b11_compact_cross_prefix", {"hit": lambda: match.compact_cross_prefix(h(), text.squash(n()))}, {"hit": d.compact_cross("h", d.flat("n"))})
_pair_query("b12_token_fallback", {"hit": lambda: match.token_fallback(h(), toks())}, {"hit": d.fallback("h", d.dot_words("n"))})
_pair_query("b13_query_matches", {"hit": lambda: match.query_matches(h(), n(), n(), toks())}, {"hit": d.query_matches("h", "n", "n", d.dot_words("n"))})
_pair_query("b14_template_match", {"hit": lambda: match.template_match(n(), cat())}, {"hit": d.template_match("n", "cat")})
_pair_query("b15_category_evidence", {"hit": lambda: match.category_evidence(h(), n())}, {"hit": d.category_evidence("h", "n")})
_pair_query("b16_phrase_evidence", {"hit": lambda: match.phrase_evidence(n(), cat())}, {"hit": d.phrase_evidence("n", "cat")})
_pair_query("b37_expected_match", {"hit": lambda: match.expected_match(h(), n())}, {"hit": "(contains(h, n) OR contains(n, h))"})
_pair_query(
    "b36_is_unresolved_compact", {"hit": lambda: match.is_unresolved_compact(n(), n(), F.array().cast("array<string>"))},
    {"hit": "(NOT contains(n, ' ') AND length(n) >= 6)"},
)
_pair_query("b35_is_coordinate_like", {"hit": lambda: text.is_coordinate_like(n())}, {"hit": "(regexp_full_match(n, '[0-9. ,]+') AND regexp_matches(n, '[0-9]'))"})

SEM_SQL = PAIR_SQL + [
    f"sx AS MATERIALIZED (SELECT n, h, {d.expand_semantic('n')} AS nx, {d.expand_semantic('h')} AS hx FROM pq)",
    f"st AS MATERIALIZED (SELECT n, h, nx, hx, {d.sem_tokens('nx')} AS qt, {d.sem_tokens('hx')} AS dt, {d.grams(d.flat('nx'))} AS qg, {d.grams(d.flat('hx'))} AS dg FROM sx)",
]


def _sem_query(name: str, columns: dict, sql: dict) -> None:
    chosen = ", ".join(f"{e} AS {a}" for a, e in sql.items())

    @query(name, d.with_(SEM_SQL, f"SELECT n, h, {chosen} FROM st"))
    def run(spark, sf) -> DataFrame:
        distinct = _pairs(spark, sf).select("n", "h").distinct()
        return distinct.select("n", "h", *[build().alias(a) for a, build in columns.items()])


ex = match.expand_semantic
SIM = f"least(1.0::DOUBLE, ({d.overlap('qt', 'dt')}) * 0.72::DOUBLE + ({d.dice('qg', 'dg')}) * 0.28::DOUBLE)"
_sem_query("b30_weighted_token_overlap", {"overlap": lambda: F.round(match.weighted_token_overlap(match.semantic_tokens(ex(n())), match.semantic_tokens(ex(h()))), 6)}, {"overlap": f"round({d.overlap('qt', 'dt')}, 6)"})
_sem_query("b31_expand_semantic", {"expanded": lambda: ex(n())}, {"expanded": "nx"})
_sem_query("b32_semantic_similarity", {"similarity": lambda: match.semantic_similarity(n(), h())}, {"similarity": d.round3(SIM)})
_sem_query("b33_strong_semantic_evidence", {"hit": lambda: match.strong_semantic_evidence(n(), h())}, {"hit": d.strong("qt", "dt")})


@query("b18_with_city_key", d.with_(d.inputs("requests"), f"SELECT request_id, {d.city_key(d.norm('city'))} AS city_key FROM in_requests WHERE city IS NOT NULL"))
def b18(spark, sf):
    return inp(spark, sf, "requests").filter("city is not null").select("request_id", city_key(text.normalize_text(c("city"))).alias("city_key"))


HCM = d.has_phrase(d.norm("city"), "'ho chi minh'")


@query(
    "b19_with_behavior_city_key",
    d.with_(
        d.inputs("events"),
        f"SELECT ingest_seq, CASE WHEN {HCM} THEN 'tp.hcm' ELSE {d.city_key(d.norm('city'))} END AS city_key FROM in_events WHERE city IS NOT NULL",
    ),
)
def b19(spark, sf):
    return inp(spark, sf, "events").filter("city is not null").select("ingest_seq", behavior_city_key(text.normalize_text(c("city"))).alias("city_key"))


@query("b20_street_from_address", d.with_(d.inputs("pois"), "SELECT poi_id, trim(regexp_replace(string_split(address, ',')[1], '^[0-9]+ +', '')) AS street FROM in_pois"))
def b20(spark, sf):
    return inp(spark, sf, "pois").select("poi_id", text.street_from_address(c("address")).alias("street"))


DIST = d.haversine("lat", "lon", "latitude", "longitude")


def _distance_rows(spark, sf):
    return _pairs(spark, sf).filter("lat is not null").withColumn("m", geo.haversine_m(c("lat"), c("lon"), c("latitude"), c("longitude")))


@query("b21_haversine_m", d.with_(PAIR_SQL, f"SELECT request_id, round({DIST}, 3) AS meters FROM pr WHERE lat IS NOT NULL"))
def b21(spark, sf):
    return _distance_rows(spark, sf).select("request_id", F.round("m", 3).alias("meters"))


@query(
    "b22_distance_locality",
    d.with_(PAIR_SQL, f"SELECT request_id, {d.round3(f'0.25::DOUBLE + (1 - least(greatest({DIST} / 40, 0), 15000) / 15000) * 0.75::DOUBLE')} AS locality FROM pr WHERE lat IS NOT NULL"),
)
def b22(spark, sf):
    return _distance_rows(spark, sf).select("request_id", geo.distance_locality(c("m") / 40.0).alias("locality"))


@query(
    "b23_distance_label",
    d.with_(
        PAIR_SQL + [f"m AS (SELECT request_id, {DIST} / (1 + request_id % 300) AS m FROM pr WHERE lat IS NOT NULL)"],
        "SELECT request_id, CASE WHEN m < 1000 THEN CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR) || ' m' "
        "WHEN m < 10000 THEN printf('%.1f', m / 1000) || ' km' ELSE CAST(CAST(floor(m / 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' km' END AS label FROM m",
    ),
)
def b23(spark, sf):
    return _distance_rows(spark, sf).select("request_id", geo.distance_label(c("m") / (1 + c("request_id") % 300)).alias("label"))


CLOCK = "CAST(substr(now, 12, 2) AS INT) * 60 + CAST(substr(now, 15, 2) AS INT)"


@query("b24_clock_minutes", d.with_(d.inputs("requests"), f"SELECT request_id, {CLOCK} AS minutes FROM in_requests WHERE now IS NOT NULL"))
def b24(spark, sf):
    return inp(spark, sf, "requests").filter("now is not null").select("request_id", geo.clock_minutes(c("now")).alias("minutes"))


HOURS_CYCLE = ["07:00-22:00", "00:00-24:00", "22:30-06:00", "09:00-09:00", "closed", "18:15-24:00"]


def _hours_sql(body: str) -> str:
    from prefixlake.sources.tables import pick

    return f"SELECT o_orderkey, {body} FROM (SELECT o_orderkey, {pick('o_orderkey', HOURS_CYCLE)} AS hours, CAST(o_custkey % 1440 AS INT) AS m, o_custkey % 3 <> 0 AS ok FROM orders)"


def _hours_rows(spark, sf):
    from prefixlake.sources.tables import pick

    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{pick('o_orderkey', HOURS_CYCLE)} AS hours", "CAST(o_custkey % 1440 AS INT) AS m", "o_custkey % 3 <> 0 AS ok")


@query(
    "b25_within_hours",
    _hours_sql(
        "CASE hours WHEN '07:00-22:00' THEN m >= 420 AND m < 1320 WHEN '00:00-24:00' THEN true WHEN '22:30-06:00' THEN m >= 1350 OR m < 360 "
        "WHEN '09:00-09:00' THEN false WHEN '18:15-24:00' THEN m >= 1095 ELSE false END AS open"
    ),
)
def b25(spark, sf):
    return _hours_rows(spark, sf).select("o_orderkey", geo.within_hours(c("hours"), c("m")).alias("open"))


@query(
    "b26_corridor_open_state",
    _hours_sql(
        "CASE WHEN NOT ok THEN NULL ELSE CASE hours WHEN '07:00-22:00' THEN m >= 420 AND m <= 1320 WHEN '00:00-24:00' THEN true "
        "WHEN '22:30-06:00' THEN m >= 1350 AND m <= 360 WHEN '09:00-09:00' THEN m = 540 WHEN '18:15-24:00' THEN m >= 1095 AND m <= 1440 ELSE NULL END END AS open"
    ),
)
def b26(spark, sf):
    ts = F.timestamp_micros(c("m").cast("bigint") * 60_000_000)
    return _hours_rows(spark, sf).select("o_orderkey", geo.corridor_open_state(c("hours"), c("ok"), ts).alias("open"))


@query("b27_round3", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, floor(l_extendedprice * l_discount / 777 * 1000 + 0.5) / 1000 AS r, least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity / 25 - 0.5::DOUBLE)) AS cl FROM lineitem")
def b27(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", num.round3(c("l_extendedprice") * c("l_discount") / 777).alias("r"),
        num.clamp01(c("l_quantity") / 25 - 0.5).alias("cl"),
    )


@query(
    "b28_slug",
    f"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace({d.norm('url')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'place') AS slug, "
    f"'generated:' || replace({d.norm('url')}, ' ', '-') AS stable_id FROM pages",
)
def b28(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.slug(c("url")).alias("slug"), text.stable_id(c("url")).alias("stable_id"))


TELEX = "t"
for _code, _letter in [("dd", "d"), ("aa", "a"), ("aw", "a"), ("ee", "e"), ("oo", "o"), ("ow", "o"), ("uw", "u")]:
    TELEX = f"replace({TELEX}, '{_code}', '{_letter}')"


@query(
    "b34_telex_candidates",
    f"WITH w AS (SELECT DISTINCT unnest({d.words(N_TEXT)}) AS t FROM documents) SELECT t, regexp_replace({TELEX}, '([aeiouy])w', '\\1', 'g') AS plain, "
    "regexp_replace(t, '([aeiouy][a-z]*?)[sfrxj]$', '\\1') AS toneless FROM w WHERE length(t) >= 3",
)
def b34(spark, sf):
    tokens = _docs(spark, sf).select(F.explode(text.words(norm())).alias("t")).distinct().filter("length(t) >= 3")
    return tokens.filter(F.size(telex_candidates(c("t"))) >= 0).select("t", telex_plain(c("t")).alias("plain"), telex_toneless(c("t")).alias("toneless"))


LABEL_SQL = "p_brand || ' ' || CASE p_size % 12 " + " ".join(
    f"WHEN {i} THEN '{w}'" for i, w in enumerate(["Brand Suggestions", "category x", "NEARBY", "Poi", "Address", "Location", "Discovery", "navigation", "Attribute", "Coordinate", "other", "none"])
) + " END"


@query(
    "b38_expected_intent",
    f"SELECT p_partkey, CASE WHEN contains(x, 'brand') THEN 'Brand Search' WHEN contains(x, 'category') THEN 'Category Search' WHEN contains(x, 'nearby') THEN 'Nearby Search' "
    "WHEN contains(x, 'poi') THEN 'POI Search' WHEN contains(x, 'address') THEN 'Address Suggestion' WHEN contains(x, 'location') THEN 'Location Search' "
    "WHEN contains(x, 'discovery') THEN 'Discovery Search' WHEN contains(x, 'navigation') THEN 'Navigation' WHEN contains(x, 'attribute') THEN 'Attribute Search' "
    f"WHEN contains(x, 'coordinate') THEN 'Coordinate Search' ELSE 'Ambiguous' END AS intent FROM (SELECT p_partkey, {d.norm(LABEL_SQL)} AS x FROM part)",
)
def b38(spark, sf):
    return table(spark, sf, "part").select("p_partkey", match.expected_intent(F.expr(LABEL_SQL)).alias("intent"))


SEG = ("10.0::DOUBLE", "103.0::DOUBLE", "16.5::DOUBLE", "107.25::DOUBLE")
_mean = f"radians(({SEG[0]} + {SEG[2]} + latitude) / 3)"


@query(
    "b39_segment_distance_m",
    d.with_(
        d.inputs("pois") + [
            f"s AS (SELECT poi_id, {SEG[1]} * 111320 * cos({_mean}) AS ax, {SEG[0]} * 110540 AS ay, {SEG[3]} * 111320 * cos({_mean}) AS bx, {SEG[2]} * 110540 AS b_y, "
            f"longitude * 111320 * cos({_mean}) AS px, latitude * 110540 AS py FROM in_pois)",
            "t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM s)",
        ],
        "SELECT poi_id, round(sqrt((px - ax - t * (bx - ax)) * (px - ax - t * (bx - ax)) + (py - ay - t * (b_y - ay)) * (py - ay - t * (b_y - ay))), 3) AS meters FROM t",
    ),
)
def b39(spark, sf):
    return inp(spark, sf, "pois").select(
        "poi_id", F.round(geo.segment_distance_m(c("latitude"), c("longitude"), F.lit(10.0), F.lit(103.0), F.lit(16.5), F.lit(107.25)), 3).alias("meters")
    )


def poi_type_sql(n: str, e: str, tokens: str) -> str:
    brand_words = d.words(d.norm("brand")).replace("lambda t: t", "lambda y: y")
    brand_hit = d.any_of(tokens, "length(t) >= 3 AND " + d.any_of(brand_words, "starts_with(b, t)", "b"))
    cat_words = f"string_split({d.norm('category')}, ' ')"
    return (
        f"CASE WHEN {d.has_any(e, ['gan day', 'gan nhat'])} THEN 'Nearby Search' WHEN {d.has_any(e, ['gan bien', '24 7', 'hoc bai', 'an dem'])} THEN 'Discovery Search' "
        f"WHEN {d.prefix_phrase(d.norm(chr(40) + 'poi_name || chr(32) || address' + chr(41)), n)} THEN 'Address Suggestion' "
        f"WHEN {d.has_any(d.norm('category'), ['atm', 'cay xang', 'benh vien'])} THEN 'Nearby Search' WHEN brand <> '' AND {brand_hit} THEN 'Brand Search' "
        f"WHEN len(list_intersect({cat_words}, {tokens})) > 0 THEN 'Category Search' ELSE 'POI Search' END"
    )


@query("b40_poi_suggestion_type", d.with_(PAIR_SQL, f"SELECT request_id, {poi_type_sql('n', 'n', d.dot_words('n'))} AS type FROM pr"))
def b40(spark, sf):
    return _pairs(spark, sf).select("request_id", match.poi_suggestion_type(c("poi_name"), c("category"), c("brand"), c("address"), n(), n(), toks()).alias("type"))


@query("b41_category_intent", d.with_(d.inputs("pois"), f"SELECT poi_id, {d.category_intent(d.norm('category'))} AS intent FROM in_pois"))
def b41(spark, sf):
    return inp(spark, sf, "pois").select("poi_id", match.category_intent(c("category")).alias("intent"))


@query(
    "b42_equivalent",
    f"SELECT s_suppkey, {d.norm('s_name')} = {d.norm('c_name')} AS same_name, abs(s_acctbal - c_acctbal) < 0.000001 AS same_balance, "
    f"list_sort([{d.norm('s_name')}, {d.norm('c_name')}]) = list_sort([{d.norm('c_name')}, {d.norm('s_name')}]) AS same_list FROM supplier JOIN customer ON s_suppkey = c_custkey",
)
def b42(spark, sf):
    both = table(spark, sf, "supplier").join(table(spark, sf, "customer"), c("s_suppkey") == c("c_custkey"))
    return both.select(
        "s_suppkey", match.equivalent_text(c("s_name"), c("c_name")).alias("same_name"), match.equivalent_number(c("s_acctbal"), c("c_acctbal")).alias("same_balance"),
        match.equivalent_list(F.array("s_name", "c_name"), F.array("c_name", "s_name")).alias("same_list"),
    )



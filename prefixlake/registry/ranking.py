"""Registered queries of intent, scoring and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.text import normalize_text
from prefixlake.operators import intent as I
from prefixlake.operators import rank as K
from prefixlake.operators.retrieve import poi_struct
from prefixlake.plans import suggest as plan
from prefixlake.registry import duck as d
from prefixlake.registry import shared as S
from prefixlake.registry.core import held, inp, query, table
from prefixlake.registry.understanding import ENTITY_CTES
from prefixlake.rules import ENTITY_INTENTS, FACTORS, LEARNED_WEIGHTS, SOURCES, VOTE_TERMS
from prefixlake.sources.tables import INTENT_CYCLE, pick

c = F.col
SOURCE_CYCLE = list(SOURCES)
CAND_COLUMNS = (
    "p_brand || '-' || p_type AS request_id, p_partkey, p_name || CASE WHEN p_size > 25 THEN ' ' || p_brand ELSE '' END AS text, "
    f"{pick('p_partkey', INTENT_CYCLE)} AS type, {pick('p_partkey', SOURCE_CYCLE)} AS source, "
    "CAST(40 + p_partkey % 60 AS DOUBLE) / 100 AS base, CAST(p_size AS DOUBLE) / 40 AS freq, CAST(p_partkey % 4 AS DOUBLE) / 10 AS boost, "
    f"{pick('p_retailprice', INTENT_CYCLE).replace('p_retailprice', 'p_size')} AS intent_type, CAST(p_size % 10 AS DOUBLE) / 10 AS locality, CAST(p_partkey % 3 AS DOUBLE) / 3 AS personal_boost"
)
_by = lambda slot: "CASE source " + " ".join(f"WHEN '{s}' THEN {row[slot]}{'' if slot == 2 else '::DOUBLE'}" for s, row in SOURCES.items()) + " END"
QUALITY = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (rating / 5) * 0.45::DOUBLE + (review_count / 10000.0::DOUBLE) * 0.25::DOUBLE + (popularity_score / 100.0::DOUBLE) * 0.3::DOUBLE))"
FACTOR_SQL = {
    "lexical": "CASE WHEN boost <> 0 THEN least(1.18::DOUBLE, base + boost) ELSE base END", "intent": "CASE WHEN type = intent_type THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END",
    "source": _by(0), "popularity": d.clamp01("freq"), "poiQuality": f"CASE WHEN poi_id IS NULL THEN 0.68::DOUBLE ELSE {QUALITY} END", "locality": "locality",
    "personalization": d.clamp01("personal_boost"), "diversity": _by(1),
}
CANDS = d.inputs("pois") + [
    f"ca AS MATERIALIZED (SELECT * FROM (SELECT {CAND_COLUMNS} FROM part) LEFT JOIN in_pois ON row_ord = p_partkey)",
    "fa AS MATERIALIZED (SELECT request_id, p_partkey, text, source AS src, " + ", ".join(f"{e} AS f_{n}" for n, e in FACTOR_SQL.items()) + " FROM ca)",
]
SCORE = " + ".join(f"f_{n} * {LEARNED_WEIGHTS[n] / sum(LEARNED_WEIGHTS.values())!r}::DOUBLE" for n in FACTORS)
SCORED = CANDS + [f"sc AS MATERIALIZED (SELECT request_id, p_partkey, text, src, {d.round3(SCORE)} AS score, {d.norm('text')} AS nt FROM fa)"]
PRIORITY = "CASE src " + " ".join(f"WHEN '{s}' THEN {row[2]}" for s, row in SOURCES.items()) + " END"
DEDUPED = SCORED + [
    "dd AS MATERIALIZED (SELECT request_id, nt, arg_min(p_partkey, [-score, p_partkey]) AS p_partkey, arg_min(src, [-score, p_partkey]) AS src, max(score) AS score, min(p_partkey) AS first_seen FROM sc GROUP BY request_id, nt)"
]


def cands(spark, sf) -> DataFrame:
    """Parts as ready-made candidates of one request per brand and type."""
    def build() -> DataFrame:
        pois = inp(spark, sf, "pois").select(c("row_ord").alias("p_partkey"), poi_struct().alias("poi"))
        rows = table(spark, sf, "part").selectExpr(*_split(CAND_COLUMNS))
        return rows.join(pois, "p_partkey", "left").select("*", F.lit(0).alias("src_ord"), c("p_partkey").alias("row_ord"))

    return held(spark, sf, "rank_cands", build)


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def scored(spark, sf) -> DataFrame:
    rows = K.score_factors(cands(spark, sf))
    total = sum(LEARNED_WEIGHTS.values())
    weights = F.struct(*[F.lit(LEARNED_WEIGHTS[n] / total).alias(n) for n in FACTORS])
    return rows.withColumn("weights", weights).withColumn("score", K.weighted_score()).withColumn("norm_text", normalize_text(c("text")))


VOTES = ENTITY_CTES + [
    "tv(i, term, type) AS (VALUES " + ", ".join(f"({i}, {d.lit(t)}, {d.lit(k)})" for i, (t, k) in enumerate(VOTE_TERMS)) + ")",
    "v1 AS (SELECT q, type, 1.4::DOUBLE AS w FROM forms, tv WHERE contains(expanded, term) OR contains(norm, term))",
    "km(kind, type) AS (VALUES " + ", ".join(f"({d.lit(k)}, {d.lit(t)})" for k, t in ENTITY_INTENTS.items()) + ")",
    "v2 AS (SELECT q, type, CASE WHEN kind = 'attribute' THEN confidence + 1.9::DOUBLE ELSE confidence END AS w FROM ent JOIN km USING (kind))",
]


@query("e1_intent_votes", d.with_(VOTES, "SELECT q, type, round(sum(w), 6) AS votes FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) GROUP BY q, type"))
def e1(spark, sf):
    asked = S.forms(spark, sf).withColumn("request_id", c("q"))
    none = asked.select("request_id", F.lit("").alias("type"), F.lit(0.0).alias("base"), F.lit(0).alias("src_ord"), F.lit(0).alias("row_ord")).filter("false")
    return I.intent_votes(none, asked, S.entities(spark, sf)).select(c("request_id").alias("q"), "type", F.round("votes", 6).alias("votes"))


@query("e2_predict_intent")
def e2(spark, sf):
    return plan.fan_out(S.requests(spark, sf).drop("cust"), S.suggested(spark, sf).intent).select("request_id", "type", "confidence")


@query(
    "e3_clear_category_intent",
    d.with_(
        ENTITY_CTES + [
            f"fc AS (SELECT q, {d.norm('arg_min(value, ord)')} AS cat FROM ent WHERE kind = 'category' GROUP BY q)",
            "sp AS (SELECT DISTINCT e.q FROM ent e JOIN forms f USING (q) WHERE kind IN ('street', 'address', 'coordinate', 'navigation') OR (kind = 'brand' AND "
            f"({d.prefix_phrase(d.norm('value'), 'norm')} OR {d.prefix_phrase(d.norm('value'), 'expanded')})))",
        ],
        f"SELECT q, CASE WHEN {d.has_any('cat', ['atm', 'benh vien', 'cay xang'])} THEN 'Nearby Search' ELSE 'Category Search' END AS type, 0.86::DOUBLE AS confidence FROM forms JOIN fc USING (q) "
        f"WHERE NOT contains(norm, ' ') AND {d.compact_cross('cat', 'norm')} AND q NOT IN (SELECT q FROM sp) AND NOT "
        + d.has_any("(norm || ' ' || expanded)", ["wifi", "24 7", "gan bien", "check in", "lam viec", "hoc tap", "gan san bay"]),
    ),
)
def e3(spark, sf):
    asked = S.forms(spark, sf).withColumn("request_id", c("q"))
    return I.clear_category_intent(asked, S.entities(spark, sf)).withColumnRenamed("request_id", "q")


@query(
    "e4_direct_evidence_intent",
    d.with_(
        d.inputs("pairs") + [
            f"t AS (SELECT input_prefix AS q, {d.norm('input_prefix')} AS v, {d.norm('suggestion_text')} AS m, suggestion_type AS type, score AS base, row_ord FROM in_pairs)",
            f"g AS (SELECT *, CASE WHEN m = v THEN 0.5::DOUBLE WHEN {d.prefix_phrase('m', 'v')} OR {d.prefix_phrase('v', 'm')} THEN 0.3::DOUBLE WHEN starts_with(m, v) THEN 0.22::DOUBLE ELSE 0 END AS p FROM t)",
            "b AS (SELECT q, type, max(s) AS s, arg_min(row_ord, [-s, row_ord]) AS o FROM (SELECT *, base + p + 0.18::DOUBLE AS s FROM g WHERE p > 0) GROUP BY q, type)",
            "r AS (SELECT *, row_number() OVER w AS rn, lead(s) OVER w AS nx FROM b WINDOW w AS (PARTITION BY q ORDER BY s DESC, o))",
        ],
        f"SELECT q, type, {d.round3('least(0.92::DOUBLE, greatest(0.72::DOUBLE, 0.76::DOUBLE + coalesce(s - nx, 0.35::DOUBLE) * 0.18::DOUBLE))')} AS confidence FROM r WHERE rn = 1 AND s >= 1.05",
    ),
)
def e4(spark, sf):
    pairs = S.catalog(spark, sf).pairs
    asked = pairs.select(c("input_prefix").alias("request_id")).distinct().select("request_id", c("request_id").alias("q"), normalize_text(c("request_id")).alias("norm"), normalize_text(c("request_id")).alias("expanded"))
    rows = pairs.select(
        c("input_prefix").alias("request_id"), F.lit("autocomplete").alias("source"), F.array("suggestion_text").alias("matched"), c("suggestion_type").alias("type"),
        c("score").alias("base"), F.lit(0.0).alias("boost"), F.lit(0).alias("src_ord"), "row_ord",
    )
    return I.direct_evidence_intent(rows, asked).withColumnRenamed("request_id", "q")


@query("e5_score_factors", d.with_(CANDS, "SELECT p_partkey, " + ", ".join(f"round(f_{n}, 9) AS {n.lower()}" for n in FACTORS) + " FROM fa"))
def e5(spark, sf):
    return K.score_factors(cands(spark, sf)).select("p_partkey", *[F.round(f"factors.{n}", 9).alias(n.lower()) for n in FACTORS])


HAY = d.norm("(poi_name || ' ' || 'POI Search' || ' ' || category || ' ' || brand || ' ' || array_to_string(tags, ' '))")
HOURS = (
    f"CASE WHEN {d.has_any(d.norm(chr(40) + 'category || chr(32) || array_to_string(tags, chr(32))' + chr(41)), ['24 7', 'atm', 'cay xang', 'benh vien', 'cap cuu', 'hospital', 'gas'])} THEN '00:00-24:00' "
    f"WHEN {d.has_any(d.norm(chr(40) + 'category || chr(32) || array_to_string(tags, chr(32))' + chr(41)), ['quan ca phe', 'cafe', 'coffee', 'nha hang', 'pho', 'fast food'])} THEN '07:00-22:00' "
    f"WHEN {d.has_any(d.norm(chr(40) + 'category || chr(32) || array_to_string(tags, chr(32))' + chr(41)), ['khach san', 'hotel', 'san bay', 'ben xe'])} THEN '00:00-24:00' ELSE '09:00-22:00' END"
)
DLOC = lambda m: d.round3(f"0.25::DOUBLE + (1 - least(greatest({m}, 0), 15000) / 15000) * 0.75::DOUBLE")


@query(
    "e6_locality_context",
    d.with_(
        d.inputs("requests", "pois") + [
            f"j AS (SELECT request_id, r.city AS rc, p.city AS pc, lat, latitude, CASE WHEN lat IS NOT NULL THEN {d.haversine('lat', 'lon', 'latitude', 'longitude')} END AS m, "
            f"CASE WHEN now IS NOT NULL THEN CAST(substr(now, 12, 2) AS INT) * 60 + CAST(substr(now, 15, 2) AS INT) END AS mi, {HAY} AS hay, {HOURS} AS hours FROM in_requests r JOIN in_pois p ON cust = row_ord)",
            f"b AS (SELECT *, CASE WHEN m IS NOT NULL THEN {DLOC('m')} WHEN rc IS NOT NULL AND {d.city_key(d.norm('rc'))} = {d.city_key(d.norm('pc'))} THEN 1.0::DOUBLE WHEN rc IS NOT NULL THEN 0.45::DOUBLE ELSE 0.7::DOUBLE END AS base, "
            "CASE WHEN mi IS NULL THEN 0 WHEN hours = '00:00-24:00' THEN 1.0::DOUBLE WHEN (hours = '07:00-22:00' AND mi >= 420 AND mi < 1320) OR (hours = '09:00-22:00' AND mi >= 540 AND mi < 1320) THEN 0.88::DOUBLE ELSE 0 END AS o, "
            f"CASE WHEN (mi >= 1260 OR mi < 300) AND {d.has_any('hay', ['24 7', '24h'])} THEN 1.0::DOUBLE WHEN (mi >= 1260 OR mi < 300) AND {d.has_any('hay', ['mo cua khuya', 'an dem', 'khuya'])} THEN 0.96::DOUBLE ELSE 0 END AS n, "
            f"CASE WHEN mi >= 300 AND mi < 600 AND (contains(' ' || hay || ' ', ' pho ') OR {d.has_any('hay', ['bua sang', 'an sang', 'breakfast'])}) THEN 0.96::DOUBLE ELSE 0 END AS e FROM j)",
        ],
        f"SELECT request_id, {d.round3('least(1.0::DOUBLE, greatest(0.0::DOUBLE, greatest(base, o, n, e)))')} AS locality FROM b",
    ),
)
def e6(spark, sf):
    reqs = S.requests(spark, sf)
    pois = S.catalog(spark, sf).pois.select(c("row_ord").alias("cust"), c("poi_name").alias("text"), poi_struct().alias("poi"))
    rows = reqs.select("request_id", "cust").join(pois, "cust").withColumn("type", F.lit("POI Search"))
    return K.locality_context(rows, reqs).select("request_id", "locality")


@query(
    "e7_resolve_weights",
    d.with_(
        d.inputs("requests") + [
            "w AS (SELECT request_id, " + ", ".join(
                f"{'greatest(' if n == 'locality' else ''}{LEARNED_WEIGHTS[n]!r}::DOUBLE{', CASE WHEN lat IS NOT NULL THEN 0.16::DOUBLE WHEN now IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END)' if n == 'locality' else ''} AS {n.lower()}"
                for n in FACTORS
            ) + " FROM in_requests)",
        ],
        "SELECT request_id, " + ", ".join(f"round({n.lower()} / ({' + '.join(x.lower() for x in FACTORS)}), 9) AS {n.lower()}" for n in FACTORS) + " FROM w",
    ),
)
def e7(spark, sf):
    return K.resolve_weights(S.requests(spark, sf)).select("request_id", *[F.round(f"weights.{n}", 9).alias(n.lower()) for n in FACTORS])


@query("e8_weighted_score", d.with_(SCORED, "SELECT p_partkey, score FROM sc"))
def e8(spark, sf):
    return scored(spark, sf).select("p_partkey", "score")


def deduped(spark, sf) -> DataFrame:
    return K.dedupe_text(scored(spark, sf), ["p_partkey", "source", "score", "src_ord", "row_ord", "factors", "text", "type"])


@query("e9_dedupe_text", d.with_(DEDUPED, "SELECT request_id, nt AS norm_text, p_partkey, score FROM dd"))
def e9(spark, sf):
    return deduped(spark, sf).select("request_id", "norm_text", "p_partkey", "score")


@query(
    "e10_top_k",
    d.with_(
        DEDUPED + [f"r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, {PRIORITY}, first_seen) AS rank FROM dd)"],
        f"SELECT request_id, rank, p_partkey, {d.round3('greatest(0.01::DOUBLE, score - (rank - 1) * 0.005::DOUBLE)')} AS score FROM r WHERE rank <= 8",
    ),
)
def e10(spark, sf):
    return K.top_k(deduped(spark, sf)).select("request_id", "rank", "p_partkey", "score")


@query("e11_explain")
def e11(spark, sf):
    told = K.explain(S.suggested(spark, sf).ranked).select("request_id", "rank", "summary", F.concat_ws(" / ", "evidence").alias("evidence"))
    return plan.fan_out(S.requests(spark, sf).drop("cust"), told).select("request_id", "rank", "summary", "evidence")


@query("e12_suggest")
def e12(spark, sf):
    ranked = plan.fan_out(S.requests(spark, sf).drop("cust"), S.suggested(spark, sf).ranked)
    return ranked.select("request_id", "rank", "id", "text", "type", "source", "score")


@query("e13_top_texts")
def e13(spark, sf):
    """The first five texts of every request, whatever its own limit."""
    first = plan.first_texts(S.suggested(spark, sf).best)
    return plan.fan_out(S.requests(spark, sf).drop("cust"), first).select("request_id", F.concat_ws(" | ", "texts").alias("texts"))


@query("e14_diagnostics")
def e14(spark, sf):
    return plan.diagnostics(S.suggested(spark, sf)).select(
        "request_id", "candidate_count", F.concat_ws("; ", "expansions").alias("expansions"), F.concat_ws(", ", "neighbours").alias("neighbours"), "intent_type", "intent_confidence"
    )


@query(
    "e14_row_counts",
    "SELECT 'autocomplete' AS table_name, count(*) AS n_rows FROM part UNION ALL SELECT 'pois', count(*) FROM customer UNION ALL SELECT 'abbreviations', count(*) FROM nation "
    "UNION ALL SELECT 'popularQueries', count(*) FROM (" + d.with_(d.inputs("popular"), "SELECT * FROM in_popular") + ")",
)
def e14b(spark, sf):
    return S.catalog(spark, sf).row_counts()



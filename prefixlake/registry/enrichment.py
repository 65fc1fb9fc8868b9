"""Registered queries of place enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.operators import enrich as X
from prefixlake.registry import duck as d
from prefixlake.registry.core import inp, query, table
from prefixlake.registry.ranking import HOURS
from prefixlake.rules import CATEGORY_LABELS, TAG_LABELS

c = F.col
P = d.inputs("pois")
FIELDS = [
    ("id", "poi_id", "stable POI identifier"), ("name", "poi_name", "POI name"), ("address", "address", "POI address"), ("category", "category", "POI category"),
    ("brand", "nullif(brand, '')", "POI brand"), ("coordinates", "CAST(latitude AS VARCHAR)", "WGS84 latitude/longitude"), ("rating", "CAST(rating AS VARCHAR)", "POI rating"),
    ("reviewCount", "CAST(review_count AS VARCHAR)", "POI review_count"), ("popularityScore", "CAST(popularity_score AS VARCHAR)", "POI popularity_score"),
    ("tags", "CASE WHEN len(tags) > 0 THEN 'x' END", "POI tags"),
]


@query(
    "i1_field_provenance",
    d.with_(P, " UNION ALL ".join(f"SELECT poi_id, '{f}' AS field, 0.86::DOUBLE AS confidence, '{e}' AS evidence FROM in_pois WHERE {x} IS NOT NULL" for f, x, e in FIELDS)),
)
def i1(spark, sf):
    return X.field_provenance(inp(spark, sf, "pois")).select("poi_id", "field", "confidence", F.array_join("evidence", ";").alias("evidence"))


@query("i2_opening_hours", d.with_(P, f"SELECT poi_id, hours, CASE WHEN hours = '07:00-22:00' THEN 0.58::DOUBLE WHEN hours = '09:00-22:00' THEN 0.48::DOUBLE WHEN {d.has_any(d.norm(chr(40) + 'category || chr(32) || array_to_string(tags, chr(32))' + chr(41)), ['24 7', 'atm', 'cay xang', 'benh vien', 'cap cuu'])} THEN 0.68::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM (SELECT *, {HOURS} AS hours FROM in_pois)"))
def i2(spark, sf):
    return X.opening_hours(inp(spark, sf, "pois"))


NUM = "CASE WHEN rating = floor(rating) THEN CAST(CAST(rating AS BIGINT) AS VARCHAR) ELSE printf('%.1f', rating) END"
INT = lambda x: f"replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '.')"


@query(
    "i3_evidence_summary",
    d.with_(
        P,
        f"SELECT poi_id, poi_name || ' là ' || lower(left(category, 1)) || substr(category, 2) || ' tại ' || address || '. Dữ liệu hackathon ghi nhận điểm ' || {NUM} || '/5, ' || {INT('review_count')} || ' lượt đánh giá, độ phổ biến ' "
        f"|| {INT('popularity_score')} || '/100.' || CASE WHEN len(tags) > 0 THEN ' Thuộc tính nổi bật: ' || array_to_string(tags[:4], ', ') || '.' ELSE '' END AS summary FROM in_pois",
    ),
)
def i3(spark, sf):
    return X.evidence_summary(inp(spark, sf, "pois")).select("poi_id", "summary")


_cases = lambda table_, key, default: f"CASE {key} " + " ".join(f"WHEN {d.lit(k)} THEN {d.lit(v)}" for k, v in table_.items()) + f" ELSE {default} END"
ATTR = P + [
    f"att AS (SELECT poi_id, 0 AS o, 'category:' || replace({d.norm('category')}, ' ', '-') AS key, {_cases(CATEGORY_LABELS, d.norm('category'), 'category')} AS label, 0.86::DOUBLE AS confidence FROM in_pois "
    f"UNION ALL SELECT poi_id, i, 'tag:' || regexp_replace({d.norm('t')}, '[^a-z0-9]+', '-', 'g'), {_cases(TAG_LABELS, d.norm('t'), 't')}, 0.84::DOUBLE FROM (SELECT poi_id, unnest(tags) AS t, generate_subscripts(tags, 1) AS i FROM in_pois) "
    "UNION ALL SELECT poi_id, 100, CASE WHEN rating >= 4.5 THEN 'quality:high-rating' ELSE 'quality:good-rating' END, CASE WHEN rating >= 4.5 THEN 'Đánh giá rất tốt' ELSE 'Đánh giá tốt' END, CASE WHEN rating >= 4.5 THEN 0.82::DOUBLE ELSE 0.78::DOUBLE END FROM in_pois WHERE rating >= 4 "
    "UNION ALL SELECT poi_id, 101, 'quality:many-reviews', 'Nhiều lượt đánh giá', 0.8::DOUBLE FROM in_pois WHERE review_count >= 1000 "
    "UNION ALL SELECT poi_id, 102, CASE WHEN popularity_score >= 90 THEN 'popularity:very-high' ELSE 'popularity:high' END, CASE WHEN popularity_score >= 90 THEN 'Rất phổ biến' ELSE 'Phổ biến' END, CASE WHEN popularity_score >= 90 THEN 0.83::DOUBLE ELSE 0.77::DOUBLE END FROM in_pois WHERE popularity_score >= 75)",
    "au AS MATERIALIZED (SELECT poi_id, key, label, confidence, row_number() OVER (PARTITION BY poi_id ORDER BY o) - 1 AS ord FROM (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY poi_id, key ORDER BY o) = 1))",
]


@query("i4_derive_attributes", d.with_(ATTR, "SELECT poi_id, ord, key, label, confidence FROM au"))
def i4(spark, sf):
    return X.derive_attributes(inp(spark, sf, "pois")).select("poi_id", "ord", "key", "label", "confidence")


GROUP = "CASE WHEN starts_with(key, 'tag:wifi') THEN 0 WHEN starts_with(key, 'tag:gan-bien') THEN 1 WHEN starts_with(key, 'tag:24-7') THEN 2 WHEN starts_with(key, 'tag:yen-tinh') THEN 3 WHEN starts_with(key, 'tag:lam-viec') THEN 4 WHEN starts_with(key, 'quality:') THEN 5 WHEN starts_with(key, 'popularity:') THEN 6 ELSE 7 END"


@query("i5_ranking_evidence", d.with_(ATTR + [f"r AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY {GROUP}, confidence DESC, ord) - 1 AS rn FROM au)"], "SELECT poi_id, rn AS ord, key FROM r WHERE rn < 6"))
def i5(spark, sf):
    return X.ranking_evidence(inp(spark, sf, "pois")).select("poi_id", "ord", "key")


@query(
    "i6_reconcile",
    f"SELECT s_suppkey AS id, field, local_value, live_value FROM (SELECT s_suppkey, 'label' AS field, s_name AS local_value, c_name AS live_value, {d.norm('s_name')} <> {d.norm('c_name')} AS differs FROM supplier JOIN customer ON s_suppkey = c_custkey "
    "UNION ALL SELECT s_suppkey, 'review_count', CAST(s_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), s_nationkey <> c_nationkey FROM supplier JOIN customer ON s_suppkey = c_custkey) WHERE differs",
)
def i6(spark, sf):
    local = table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("label"), c("s_nationkey").alias("review_count"))
    live = table(spark, sf, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("label"), c("c_nationkey").alias("review_count"))
    return X.reconcile(local, live).select("id", "field", "local_value", "live_value")


@query("i7_summary_evidence", d.with_(P, "SELECT poi_id, 'label,category,address,rating,reviewCount,popularityScore' || CASE WHEN len(tags) > 0 THEN ',tags' ELSE '' END AS evidence FROM in_pois"))
def i7(spark, sf):
    return X.summary_evidence(inp(spark, sf, "pois")).select("poi_id", F.array_join("evidence", ",").alias("evidence"))


@query(
    "i8_enrichment_coverage",
    d.with_(ATTR + ["n AS (SELECT poi_id, count(*) AS k FROM au GROUP BY poi_id)"], f"SELECT count(*) AS poi_rows, min(k) AS min_attributes, {d.round3('avg(k)')} AS avg_attributes, CAST(sum(CASE WHEN hours <> '' THEN 1 ELSE 0 END) AS BIGINT) AS hours_rows FROM (SELECT poi_id, {HOURS} AS hours FROM in_pois) JOIN n USING (poi_id)"),
)
def i8(spark, sf):
    return X.enrichment_coverage(inp(spark, sf, "pois")).select("poi_rows", "min_attributes", "avg_attributes", "hours_rows")


@query("i8_weakest_places", d.with_(ATTR + ["n AS (SELECT poi_id, count(*) AS k FROM au GROUP BY poi_id)"], "SELECT poi_id, poi_name AS label, k AS attribute_count FROM in_pois JOIN n USING (poi_id) ORDER BY k, poi_id LIMIT 10"))
def i8b(spark, sf):
    return X.weakest_places(inp(spark, sf, "pois")).select("poi_id", "label", "attribute_count")


@query("i9_poi_detail", d.with_(P, f"SELECT 'poi:' || poi_id AS id, poi_name AS label, address, category, nullif(brand, '') AS brand, {d.round3('popularity_score / 100.0::DOUBLE')} AS score, {HOURS} AS opening_hours FROM in_pois"))
def i9(spark, sf):
    return X.poi_detail(inp(spark, sf, "pois"), ("hours", "ai_summary")).select("id", "label", "address", "category", "brand", "score", "opening_hours")



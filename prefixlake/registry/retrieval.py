"""Registered queries of candidate retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.text import plain
from prefixlake.operators import patterns as P
from prefixlake.operators import phrases as G
from prefixlake.operators import retrieve as R
from prefixlake.operators.cities import filter_city, mention_aliases
from prefixlake.plans.suggest import filter_category, neighbours
from prefixlake.registry import duck as d
from prefixlake.registry import shared as S
from prefixlake.registry.core import held, query
from prefixlake.registry.understanding import ENTITY_CTES
from prefixlake.rules import CITY_ALIASES, TEMPLATES

c = F.col
CTX = d.form_ctes() + [
    "ctx AS MATERIALIZED (SELECT q, city, lat, lon, now, min(request_id) AS request_id FROM in_requests GROUP BY ALL)",
    "cf AS MATERIALIZED (SELECT ctx.*, norm, expanded, tokens, coalesce(city, '') <> '' OR (lat IS NOT NULL AND lon IS NOT NULL) AS located FROM ctx JOIN forms USING (q))",
]
FREQ = "/ 15000.0::DOUBLE"


def flat(df: DataFrame) -> DataFrame:
    """Candidates without nested columns, for comparison."""
    return df.select("request_id", "id", "text", "type", F.concat_ws("|", "matched").alias("matched"), "base", F.round("freq", 9).alias("freq"), "boost", "reason")


def field_hits(values: str) -> list[str]:
    """``hv``: (norm, expanded, h) brute-force matches of distinct values in ``vals``(h)."""
    return [
        f"vals AS MATERIALIZED (SELECT DISTINCT h FROM ({values}) WHERE h <> '')",
        "dq AS MATERIALIZED (SELECT DISTINCT norm, expanded, tokens FROM forms WHERE norm <> '')",
        f"hv AS MATERIALIZED (SELECT norm, expanded, h FROM dq, vals WHERE {d.query_matches('h', 'norm', 'expanded', 'tokens')})",
    ]


@query(
    "d0_popular_fallback",
    d.with_(
        d.inputs("popular") + ["top AS (SELECT * FROM in_popular ORDER BY row_ord LIMIT 5)", "r AS (SELECT DISTINCT o_custkey AS request_id FROM orders)"],
        f"SELECT request_id, query_id AS id, query_text AS text, intent_type AS type, 'popular' AS matched, 0.62::DOUBLE AS base, round(monthly_frequency {FREQ}, 9) AS freq, 0.0::DOUBLE AS boost, 'popular search fallback' AS reason FROM r, top",
    ),
)
def d0(spark, sf):
    empty = S.requests(spark, sf).select(c("cust").alias("request_id"), F.lit("").alias("norm")).distinct()
    return flat(R.popular_fallback(empty, S.catalog(spark, sf)))


NEARBY = "regexp_matches(norm, '(^| )gan( (day|nhat))?$') AND " + d.has_any(d.norm("suggestion_text"), ["gan day", "gan nhat"])


@query(
    "d1_from_pairs",
    d.with_(
        CTX + d.inputs("pairs") + [f"pn AS MATERIALIZED (SELECT *, {d.norm('input_prefix')} AS hp, {d.norm('suggestion_text')} AS ht FROM in_pairs)"]
        + field_hits("SELECT hp AS h FROM pn UNION ALL SELECT ht FROM pn") + [
            "m AS (SELECT dq.norm, dq.expanded, pn.*, a.h IS NOT NULL AS mp, b.h IS NOT NULL AS mt FROM dq CROSS JOIN pn LEFT JOIN hv a ON a.norm = dq.norm AND a.expanded = dq.expanded AND a.h = hp "
            "LEFT JOIN hv b ON b.norm = dq.norm AND b.expanded = dq.expanded AND b.h = ht WHERE a.h IS NOT NULL OR b.h IS NOT NULL)",
            f"m2 AS (SELECT *, {NEARBY} AS near, least(1.12::DOUBLE, score + CASE WHEN {d.prefix_phrase('hp', 'norm')} OR {d.prefix_phrase('hp', 'expanded')} THEN 0.16::DOUBLE ELSE 0 END) AS strength FROM m)",
        ],
        f"SELECT request_id, suggestion_id AS id, suggestion_text AS text, CASE WHEN near THEN 'Nearby Search' ELSE suggestion_type END AS type, "
        "CASE WHEN mp AND mt THEN input_prefix || '|' || suggestion_text WHEN mp THEN input_prefix ELSE suggestion_text END AS matched, "
        f"CASE WHEN near AND located THEN 0.58::DOUBLE ELSE strength END AS base, round(query_frequency {FREQ}, 9) AS freq, 0.0::DOUBLE AS boost, 'historical autocomplete pair' AS reason "
        "FROM m2 JOIN cf USING (norm, expanded)",
    ),
)
def d1(spark, sf):
    return flat(held(spark, sf, "d1", lambda: R.from_pairs(S.contexts(spark, sf), S.catalog(spark, sf))))


@query("d2_from_pois")
def d2(spark, sf):
    return flat(R.from_pois(S.contexts(spark, sf), S.catalog(spark, sf), S.entities(spark, sf)))


D2_FIELDS = (
    f"SELECT poi_id, row_ord, pos, {d.norm('v')} AS h, v FROM (SELECT poi_id, row_ord, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM "
    "(SELECT poi_id, row_ord, list_concat([poi_name, brand, category, address, city], tags) AS l FROM in_pois)) WHERE v <> ''"
)


@query(
    "d2_poi_field_matches",
    d.with_(
        d.form_ctes() + d.inputs("pois") + [f"pf AS MATERIALIZED ({D2_FIELDS})"] + field_hits("SELECT h FROM pf"),
        "SELECT f.q, poi_id, string_agg(v, '|' ORDER BY pos) AS matched FROM hv JOIN pf USING (h) JOIN forms f USING (norm, expanded) GROUP BY f.q, poi_id",
    ),
)
def d2b(spark, sf):
    pois = S.catalog(spark, sf).pois
    fields = pois.select(c("poi_id").alias("key"), F.posexplode(F.concat(F.array("poi_name", "brand", "category", "address", "city"), "tags")).alias("pos", "value"))
    hits = R._field_hits(S.forms(spark, sf), fields).withColumn("hits", F.filter("hits", lambda x: x["full"])).filter("size(hits) > 0")
    return hits.select("q", c("key").alias("poi_id"), F.array_join(F.transform("hits", lambda x: x["value"]), "|").alias("matched"))


@query(
    "d3_from_popular",
    d.with_(
        CTX + d.inputs("popular") + [f"pn AS MATERIALIZED (SELECT *, {d.norm('query_text')} AS hp, {d.norm('region')} AS ht FROM in_popular)"]
        + field_hits("SELECT hp AS h FROM pn UNION ALL SELECT ht FROM pn") + [
            "m AS (SELECT dq.norm, dq.expanded, pn.*, a.h IS NOT NULL AS mp, b.h IS NOT NULL AS mt FROM dq CROSS JOIN pn LEFT JOIN hv a ON a.norm = dq.norm AND a.expanded = dq.expanded AND a.h = hp "
            "LEFT JOIN hv b ON b.norm = dq.norm AND b.expanded = dq.expanded AND b.h = ht WHERE a.h IS NOT NULL OR b.h IS NOT NULL)",
        ],
        "SELECT request_id, query_id AS id, query_text AS text, intent_type AS type, CASE WHEN mp AND mt THEN query_text || '|' || region WHEN mp THEN query_text ELSE region END AS matched, "
        f"0.82::DOUBLE AS base, round(monthly_frequency {FREQ}, 9) AS freq, 0.0::DOUBLE AS boost, 'popular query trend' AS reason FROM m JOIN cf USING (norm, expanded)",
    ),
)
def d3(spark, sf):
    return flat(held(spark, sf, "d3", lambda: R.from_popular(S.contexts(spark, sf), S.catalog(spark, sf))))


DOC_SQL = d.inputs("pairs", "pois", "popular") + [
    "docs AS MATERIALIZED (SELECT 'semantic-autocomplete-' || suggestion_id AS doc_id, input_prefix || ' ' || suggestion_text || ' ' || suggestion_type AS text, 0 AS grp, row_ord FROM in_pairs "
    "UNION ALL SELECT 'semantic-poi-' || poi_id, poi_name || ' ' || category || ' ' || brand || ' ' || address || ' ' || city || ' ' || array_to_string(tags, ' '), 1, row_ord FROM in_pois "
    "UNION ALL SELECT 'semantic-popular-' || query_id, query_text || ' ' || intent_type || ' ' || region, 2, row_ord FROM in_popular)",
]


def docs(spark, sf) -> DataFrame:
    return S.documents(spark, sf)


D4_SQL = (
        d.form_ctes() + DOC_SQL + [
            f"vq AS MATERIALIZED (SELECT q, expanded AS query FROM forms WHERE norm <> '' AND NOT (NOT contains(norm, ' ') AND norm = expanded AND len(expansions) = 0 AND length(norm) >= 6) AND length(expanded) >= 4)",
            f"qx AS MATERIALIZED (SELECT query, {d.expand_semantic('query')} AS x FROM (SELECT DISTINCT query FROM vq))",
            f"qs2 AS MATERIALIZED (SELECT query, {d.sem_tokens('x')} AS qt, {d.grams(d.flat('x'))} AS qg FROM qx)",
            f"dn AS MATERIALIZED (SELECT *, {d.norm('text')} AS t FROM docs)",
            f"dx AS MATERIALIZED (SELECT t, {d.expand_semantic('t')} AS x FROM (SELECT DISTINCT t FROM dn))",
            f"ds AS MATERIALIZED (SELECT t, {d.sem_tokens('x')} AS dt, {d.grams(d.flat('x'))} AS dg FROM dx)",
            f"ov AS MATERIALIZED (SELECT query, t, qg, dg, {d.overlap('qt', 'dt')} AS o FROM qs2, ds WHERE {d.strong('qt', 'dt')})",
            f"sc AS (SELECT query, t, {d.round3('least(1.0::DOUBLE, o * 0.72::DOUBLE + (' + d.dice('qg', 'dg') + ') * 0.28::DOUBLE)')} AS similarity FROM ov WHERE o * 0.72 + 0.28 >= 0.4)",
            "rk AS (SELECT query, doc_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, grp, row_ord) AS rank FROM sc JOIN dn USING (t) WHERE similarity >= 0.5)",
        ]
)


@query("d4_semantic_matches", d.with_(D4_SQL, "SELECT q, doc_id, similarity, rank FROM rk JOIN vq USING (query) WHERE rank <= 12"))
def d4(spark, sf):
    return held(spark, sf, "d4", lambda: R.semantic_matches(S.forms(spark, sf), docs(spark, sf)))


@query("d4_from_semantic")
def d4b(spark, sf):
    return flat(R.from_semantic(S.contexts(spark, sf), docs(spark, sf)))


def near(spark, sf) -> DataFrame:
    return held(spark, sf, "near", lambda: neighbours(S.forms(spark, sf), S.documents(spark, sf), S.index(spark, sf)))


@query("d5_from_neighbors")
def d5(spark, sf):
    return flat(R.from_neighbors(S.contexts(spark, sf), near(spark, sf), docs(spark, sf)))


@query("d6_from_patterns")
def d6(spark, sf):
    return flat(P.from_patterns(S.contexts(spark, sf), S.catalog(spark, sf), S.entities(spark, sf)))


def completed(spark, sf) -> DataFrame:
    return held(spark, sf, "g4", lambda: G.complete_phrases(S.forms(spark, sf), S.phrases(spark, sf)))


@query("d7_from_completions")
def d7(spark, sf):
    return flat(G.from_completions(S.contexts(spark, sf), completed(spark, sf)))


def _template_rows() -> str:
    rows, i = [], 0
    for triggers, texts, kind, reason in TEMPLATES:
        for text in texts:
            for pos, trig in enumerate(triggers):
                rows.append(f"({i}, {pos}, {d.lit(trig)}, {d.lit(plain(trig))}, {d.lit(text)}, {d.lit(kind)}, {d.lit(reason)})")
            i += 1
    return ", ".join(rows)


D8_SQL = (
        CTX + [
            f"tp(i, pos, label, trig, text, type, reason) AS (VALUES {_template_rows()})",
            "fx AS MATERIALIZED (SELECT DISTINCT norm, expanded FROM forms)", "tr AS MATERIALIZED (SELECT DISTINCT trig FROM tp)",
            f"fire AS MATERIALIZED (SELECT norm, expanded, trig FROM fx, tr WHERE {d.template_match('norm', 'trig')} OR {d.template_match('expanded', 'trig')})",
            "h AS (SELECT norm, expanded, i, text, type, reason, array_to_string(list(label ORDER BY pos)[:2], '|') AS matched FROM fire JOIN tp USING (trig) GROUP BY ALL)",
            f"h2 AS (SELECT h.*, request_id, located, reason = 'mixed language nearby cafe intent' AND ({d.has_any('norm', ['gan day', 'gan nhat'])} OR suffix(norm, ' gan')) AS near FROM h JOIN cf USING (norm, expanded))",
        ]
)
D8_BODY = (
    "SELECT request_id, 'template-' || i AS id, text, CASE WHEN near THEN 'Nearby Search' ELSE type END AS type, matched, CASE WHEN near AND located THEN 0.58::DOUBLE ELSE 0.74::DOUBLE END AS base, "
        "0.82::DOUBLE AS freq, CASE WHEN near AND located THEN 0.08::DOUBLE ELSE 0.52::DOUBLE END AS boost, reason FROM h2"
)


@query("d8_from_templates", d.with_(D8_SQL, D8_BODY))
def d8(spark, sf):
    return flat(held(spark, sf, "d8", lambda: R.from_templates(S.contexts(spark, sf))))


def union(spark, sf) -> DataFrame:
    """Candidates of all nine sources; a context without a query gets the popular rows alone."""
    cat, ctx, entities = S.catalog(spark, sf), S.contexts(spark, sf), S.entities(spark, sf)
    asked = ctx.filter("norm <> ''")
    return R.union_candidates(
        R.popular_fallback(ctx, cat), R.from_pairs(asked, cat), R.from_pois(asked, cat, entities), R.from_popular(asked, cat),
        R.from_neighbors(asked, near(spark, sf), docs(spark, sf)), R.from_semantic(asked, docs(spark, sf)),
        P.from_patterns(asked, cat, entities), G.from_completions(asked, completed(spark, sf)), R.from_templates(asked),
    )


@query("d9_union_candidates")
def d9(spark, sf):
    return union(spark, sf).select("request_id", "source", "src_ord", "row_ord", "id", "text")


MENTION = " UNION ALL ".join(f"SELECT unnest([{d.lits([a for a in al if len(a) >= 3])}]) AS alias, {d.lit(k)} AS key" for k, al in CITY_ALIASES.items())


@query(
    "d10_filter_city",
    d.with_(
        D8_SQL + [
            f"al AS ({MENTION})", f"tc AS ({D8_BODY})", f"cw AS (SELECT request_id, CASE WHEN city IS NOT NULL THEN {d.city_key(d.norm('city'))} END AS want FROM ctx)",
            f"ts AS (SELECT tc.request_id, id, want, {d.norm('(text || chr(32) || reason || chr(32) || matched)')} AS n FROM tc JOIN cw USING (request_id))",
        ],
        "SELECT request_id, id FROM ts WHERE want IS NULL OR NOT EXISTS (SELECT 1 FROM al WHERE key <> want AND contains(' ' || ts.n || ' ', ' ' || alias || ' '))",
    ),
)
def d10(spark, sf):
    rows = held(spark, sf, "d8", lambda: R.from_templates(S.contexts(spark, sf)))
    return filter_city(rows, S.contexts(spark, sf), mention_aliases(S.catalog(spark, sf))).select("request_id", "id")


@query(
    "d11_filter_category",
    d.with_(
        ENTITY_CTES + D4_SQL + [
            "wanted AS (SELECT q, list(DISTINCT " + d.norm("value") + ") AS cats FROM ent WHERE kind = 'category' AND confidence >= 0.8 GROUP BY q)",
            "sm AS MATERIALIZED (SELECT q, doc_id, t AS txt FROM rk JOIN vq USING (query) JOIN dn USING (doc_id) WHERE rank <= 12)",
            f"ok AS (SELECT DISTINCT q, doc_id FROM (SELECT q, doc_id, txt, unnest(cats) AS cat FROM sm JOIN wanted USING (q)) WHERE {d.category_evidence('txt', 'cat')})",
        ],
        "SELECT q, doc_id FROM ok UNION ALL SELECT q, doc_id FROM sm WHERE q NOT IN (SELECT q FROM wanted)",
    ),
)
def d11(spark, sf):
    """Category filter over the lexical-semantic matches."""
    found = held(spark, sf, "d4", lambda: R.semantic_matches(S.forms(spark, sf), docs(spark, sf)))
    rows = found.join(docs(spark, sf).select("doc_id", "text"), "doc_id").select(
        c("q").alias("request_id"), "doc_id", "text", F.lit("semantic").alias("source"), F.lit(None).cast(R.POI).alias("poi")
    )
    asked = S.forms(spark, sf).select("q", c("q").alias("request_id"))
    return filter_category(rows, asked, S.entities(spark, sf)).select(c("request_id").alias("q"), "doc_id")

"""Registered queries of query understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.functions.text import normalize_text, plain, words
from prefixlake.operators import entities as E
from prefixlake.operators import rewrites as R
from prefixlake.operators import understand as U
from prefixlake.operators.cities import mention_aliases
from prefixlake.operators.places import infer_city
from prefixlake.registry import duck as d
from prefixlake.registry import shared as S
from prefixlake.registry.core import query, table
from prefixlake.rules import CITY_ALIASES, COMPACT_FORMS, DOMAIN_PHRASES, ENTITY_TERMS, KNOWN_CITIES, KNOWN_DISTRICTS, PROTECTED_TERMS, QUERY_ALIASES, SYLLABLES

c = F.col


@query(
    "c1_expand_queries",
    d.with_(d.form_ctes(), "SELECT q, norm, expanded, array_to_string(expansions, '; ') AS expansions, array_to_string(tokens, '|') AS tokens FROM forms"),
)
def c1(spark, sf):
    return S.forms(spark, sf).select("q", "norm", "expanded", F.concat_ws("; ", "expansions").alias("expansions"), F.concat_ws("|", "tokens").alias("tokens"))


FIXED = DOMAIN_PHRASES + [x for pair in QUERY_ALIASES for x in pair]
SHORT = [plain(a) for a, _ in QUERY_ALIASES if " " not in plain(a)]
LEXICON = d.inputs("requests", "pairs", "popular", "abbreviations", "pois") + [
    f"raw AS (SELECT unnest([{d.lits(FIXED)}]) AS t UNION ALL SELECT unnest([abbreviation, expanded_form]) FROM in_abbreviations "
    "UNION ALL SELECT unnest([input_prefix, suggestion_text]) FROM in_pairs UNION ALL SELECT unnest([query_text, region]) FROM in_popular "
    "UNION ALL SELECT unnest([poi_name, category, brand, address, city]) FROM in_pois UNION ALL SELECT unnest(tags) FROM in_pois)",
    f"phrases AS MATERIALIZED (SELECT DISTINCT p FROM (SELECT {d.norm('t')} AS p FROM (SELECT DISTINCT t FROM raw)) WHERE p <> '')",
    f"tokens AS MATERIALIZED (SELECT DISTINCT t FROM (SELECT unnest([{d.lits(SYLLABLES)}]) AS t UNION ALL SELECT unnest([{d.lits(SHORT)}]) "
    f"UNION ALL SELECT {d.norm('abbreviation')} FROM in_abbreviations WHERE NOT contains({d.norm('abbreviation')}, ' ') "
    f"UNION ALL SELECT t FROM (SELECT unnest({d.words('p')}) AS t FROM phrases) WHERE length(t) >= 2) WHERE t <> '')",
]


@query("c2_build_lexicon", d.with_(LEXICON, "SELECT 'phrase' AS kind, p AS entry FROM phrases UNION ALL SELECT 'token', t FROM tokens"))
def c2(spark, sf):
    lx = S.lexicon(spark, sf)
    return lx.phrases.select(F.lit("phrase").alias("kind"), c("phrase").alias("entry")).unionByName(lx.tokens.select(F.lit("token").alias("kind"), c("token").alias("entry")))


def _doc_tokens(spark, sf):
    """Distinct words of all documents and requests."""
    docs = table(spark, sf, "documents").select(F.explode(words(normalize_text(c("text")))).alias("token"))
    asked = S.forms(spark, sf).select(F.explode(words(c("norm"))).alias("token"))
    return docs.unionByName(asked).distinct()


@query("c3_segment_tokens")
def c3(spark, sf):
    asked = S.forms(spark, sf).select(F.explode(F.array_union(words(c("norm")), F.array(F.replace(c("norm"), F.lit(" "), F.lit(""))))).alias("token")).distinct()
    return U.segment_tokens(asked, S.lexicon(spark, sf), S.catalog(spark, sf).abbreviations).filter("segmented is not null")


TELEX = "t"
for _code, _letter in [("dd", "d"), ("aa", "a"), ("aw", "a"), ("ee", "e"), ("oo", "o"), ("ow", "o"), ("uw", "u")]:
    TELEX = f"replace({TELEX}, '{_code}', '{_letter}')"


@query(
    "c4_repair_telex",
    d.with_(
        LEXICON + [
            f"asked AS (SELECT DISTINCT t FROM (SELECT unnest({d.words(d.norm('text'))}) AS t FROM documents UNION ALL "
            f"SELECT unnest({d.words(d.norm('q'))}) FROM in_requests))",
            f"cand AS (SELECT t, regexp_replace({TELEX}, '([aeiouy])w', '\\1', 'g') AS a, regexp_replace(t, '([aeiouy][a-z]*?)[sfrxj]$', '\\1') AS b FROM asked)",
        ],
        "SELECT t AS token, CASE WHEN length(t) < 3 THEN t WHEN a <> t AND a IN (SELECT t FROM tokens) THEN a WHEN b <> t AND b IN (SELECT t FROM tokens) THEN b ELSE t END AS decoded FROM cand",
    ),
)
def c4(spark, sf):
    return U.repair_telex(_doc_tokens(spark, sf), S.lexicon(spark, sf))


@query(
    "c5_complete_proximity",
    d.with_(
        LEXICON + [
            f"f AS (SELECT DISTINCT {d.norm('q')} AS text FROM in_requests)",
            "h AS (SELECT text, left(text, length(text) - 4) AS head FROM f WHERE suffix(text, ' gan'))",
        ],
        "SELECT text, head || ' gan day' AS completed FROM h WHERE CASE WHEN contains(head, ' ') THEN head IN (SELECT p FROM phrases) ELSE head IN (SELECT t FROM tokens) END",
    ),
)
def c5(spark, sf):
    return U.complete_proximity(S.forms(spark, sf), S.lexicon(spark, sf))


@query("c6_accept_segmentation")
def c6(spark, sf):
    f = S.forms(spark, sf).filter("contains(norm, ' ')")
    variants = f.select(c("norm").alias("text"), c("expanded").alias("segmented"), (c("norm") != c("expanded")).alias("changed"))
    return U.accept_segmentation(variants, S.lexicon(spark, sf)).filter("accepted is not null")


@query("c7_propose_rewrites")
def c7(spark, sf):
    return U.propose_rewrites(S.forms(spark, sf), S.lexicon(spark, sf), S.catalog(spark, sf).abbreviations)


@query("c7_understand")
def c7u(spark, sf):
    return S.understood(spark, sf).select("q", "norm", "expanded", F.concat_ws("; ", "expansions").alias("expansions"), F.concat_ws("|", "tokens").alias("tokens"))


def _fixed_rows() -> str:
    rows, i = [], 0
    for kind, values, conf in (("city", KNOWN_CITIES, 0.88), ("district", KNOWN_DISTRICTS, 0.86)):
        for v in values:
            rows.append((i, kind, v, conf, plain(v)))
            i += 1
    for kind, value, conf, extra in ENTITY_TERMS:
        for trig in [plain(value)] + ([plain(extra)] if extra else []):
            rows.append((i, kind, value, conf, trig))
        i += 1
    return ", ".join(f"({r[0]}, {d.lit(r[1])}, {d.lit(r[2])}, {r[3]}::DOUBLE, {d.lit(r[4])})" for r in rows)


KIND_OF = (
    f"CASE WHEN {d.has_any('nv', ['gan day', 'gan nhat'])} THEN 'proximity' WHEN {d.has_any('nv', ['quan 1', 'quan 7'])} THEN 'district' "
    f"WHEN {d.has_any('nv', ['ha noi', 'da nang', 'tp.hcm', 'ho chi minh'])} THEN 'city' WHEN {d.has_any('nv', ['vietcombank', 'vincom', 'vinmec'])} THEN 'brand' ELSE 'category' END"
)
ENTITY_CTES = d.form_ctes() + d.inputs("pois") + [
    "fq AS MATERIALIZED (SELECT *, norm || ' ' || expanded AS query FROM forms)",
    "ex AS (SELECT q, unnest(expansions) AS x, generate_subscripts(expansions, 1) AS i FROM forms)",
    f"ex2 AS (SELECT q, i, v, {d.norm('v')} AS nv FROM (SELECT q, i, trim(string_split(x, '->')[2]) AS v FROM ex))",
    f"e1 AS (SELECT q, {KIND_OF} AS kind, v AS value, 'abbreviation' AS source, 0.82::DOUBLE AS confidence, [0, i, 0]::BIGINT[] AS ord FROM ex2)",
    f"terms(i, kind, value, confidence, trig) AS (VALUES {_fixed_rows()})",
    f"e2 AS (SELECT q, kind, value, 'query' AS source, confidence, [1, i, 0]::BIGINT[] AS ord FROM fq, terms WHERE {d.template_match('query', 'trig')})",
    "e3 AS (SELECT q, 'coordinate' AS kind, norm AS value, 'query' AS source, 0.95::DOUBLE AS confidence, [2, 0, 0]::BIGINT[] AS ord FROM forms WHERE regexp_full_match(norm, '[0-9]+([.][0-9]+)?') "
    "UNION ALL SELECT q, 'address', q, 'query', 0.84::DOUBLE, [2, 0, 1]::BIGINT[] FROM forms WHERE regexp_matches(norm, '^[0-9]+ +'))",
    "ct0 AS (SELECT row_ord AS i, unnest(['brand', 'poi', 'street']) AS kind, unnest([brand, poi_name, trim(regexp_replace(string_split(address, ',')[1], '^[0-9]+ +', ''))]) AS value, unnest([0, 1, 2]) AS slot FROM in_pois)",
    f"ct AS MATERIALIZED (SELECT kind, trig, slot, arg_min(value, i) AS value, min(i) AS i FROM (SELECT *, {d.norm('value')} AS trig FROM ct0 WHERE value <> '') GROUP BY kind, trig, slot)",
    f"hit AS (SELECT q, kind, value, i, slot FROM fq, ct WHERE {d.template_match('query', 'trig')} OR (kind = 'brand' AND "
    + d.any_of(d.words("trig"), d.any_of("tokens", "length(t) >= 3 AND length(b) > length(t) AND starts_with(b, t)"), "b").replace("lambda t: t <>", "lambda y: y <>") + "))",
    "e4 AS (SELECT q, kind, value, 'poi-dataset' AS source, CASE WHEN kind = 'poi' THEN 0.9::DOUBLE ELSE 0.78::DOUBLE END AS confidence, [3, i, slot]::BIGINT[] AS ord FROM hit)",
    f"every AS (SELECT *, {d.norm('value')} AS k FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4))",
    "firsts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY q, kind, k ORDER BY ord) = 1)",
    "ent AS MATERIALIZED (SELECT q, kind, value, source, confidence, rn - 1 AS ord FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY confidence DESC, ord) AS rn FROM firsts) WHERE rn <= 10)",
]


@query("c8_extract_entities", d.with_(ENTITY_CTES, "SELECT * FROM ent"))
def c8(spark, sf):
    return S.entities(spark, sf)


@query(
    "c9_merge_entities",
    d.with_(
        ENTITY_CTES + [
            "sec AS (SELECT q, kind, CASE WHEN ord % 2 = 0 THEN value ELSE value || ' x' END AS value, 'agent' AS source, 0.85::DOUBLE AS confidence, ord FROM ent WHERE kind = 'category')",
            f"a AS (SELECT *, {d.norm('value')} AS k FROM ent)", f"b AS (SELECT *, {d.norm('value')} AS k FROM sec)",
            "m AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.kind, b.kind) AS kind, coalesce(b.value, a.value) AS value, coalesce(b.source, a.source) AS source, "
            "greatest(a.confidence, b.confidence) AS confidence, CASE WHEN a.q IS NULL THEN 1 ELSE 0 END AS late, coalesce(a.ord, b.ord) AS pos FROM a FULL JOIN b ON a.q = b.q AND a.kind = b.kind AND a.k = b.k)",
        ],
        "SELECT q, kind, value, source, confidence, rn - 1 AS ord FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY confidence DESC, late, pos) AS rn FROM m) WHERE rn <= 10",
    ),
)
def c9(spark, sf):
    first = S.entities(spark, sf)
    second = first.filter("kind = 'category'").select(
        "q", "kind", F.when(c("ord") % 2 == 0, c("value")).otherwise(F.concat("value", F.lit(" x"))).alias("value"), F.lit("agent").alias("source"),
        F.lit(0.85).alias("confidence"), "ord",
    )
    return E.merge_entities(first, second)


ALIASES_SQL = " UNION ALL ".join(f"SELECT unnest([{d.lits(al)}]) AS alias, {d.lit(k)} AS key" for k, al in CITY_ALIASES.items())


@query(
    "c10_infer_city",
    d.with_(
        d.form_ctes() + d.inputs("pois") + [
            f"al AS ({ALIASES_SQL})",
            "ctx AS (SELECT q, city, lat, lon, now, min(request_id) AS request_id FROM in_requests GROUP BY ALL)",
            "pts AS MATERIALIZED (SELECT DISTINCT lat, lon FROM ctx WHERE lat IS NOT NULL)",
            f"near AS MATERIALIZED (SELECT lat, lon, arg_min(city, [dist, row_ord]) AS found, min(dist) AS dist FROM (SELECT pts.lat, pts.lon, p.city, row_ord, {d.haversine('pts.lat', 'pts.lon', 'latitude', 'longitude')} AS dist FROM pts, in_pois p) GROUP BY lat, lon)",
            "named AS MATERIALIZED (SELECT DISTINCT f.q FROM forms f, al WHERE length(alias) >= 3 AND contains(' ' || f.norm || ' ' || f.norm || ' ' || f.expanded || ' ', ' ' || alias || ' '))",
        ],
        "SELECT request_id, CASE WHEN ctx.city IS NULL AND ctx.lat IS NOT NULL AND ctx.q NOT IN (SELECT q FROM named) AND dist <= 60000 THEN found ELSE ctx.city END AS city FROM ctx LEFT JOIN near ON ctx.lat = near.lat AND ctx.lon = near.lon",
    ),
)
def c10(spark, sf):
    cat = S.catalog(spark, sf)
    return infer_city(S.contexts(spark, sf), cat.pois, mention_aliases(cat)).select("request_id", "city")


def _partials() -> str:
    order = sorted(range(len(COMPACT_FORMS)), key=lambda i: (-COMPACT_FORMS[i][6], len(COMPACT_FORMS[i][0])))
    arms = " ".join(f"WHEN x = {d.lit(f[0])} THEN {i}" for i, f in enumerate(COMPACT_FORMS))
    arms += " " + " ".join(
        f"WHEN length(x) >= 3 AND starts_with({d.lit(COMPACT_FORMS[i][0])}, x) AND length(x) > {len(plain(COMPACT_FORMS[i][1][0]).split(' ')[0])} THEN {100 + i}" for i in order
    )
    return f"CASE {arms} END"


@query(
    "c11_needs_rewrite",
    d.with_(
        d.form_ctes() + [
            f"s AS (SELECT q, norm, {d.flat('norm')} AS x, CAST(length(q) % 4 AS BIGINT) AS n_candidates, CAST(length(q) % 3 AS BIGINT) AS n_entities FROM forms)",
        ],
        f"SELECT q, (norm <> '' AND NOT (regexp_full_match(norm, '[0-9. ,]+') AND regexp_matches(norm, '[0-9]')) AND (n_candidates = 0 OR (n_entities = 0 AND length(x) >= 4) OR ({_partials()}) IS NOT NULL)) AS triggered FROM s",
    ),
)
def c11(spark, sf):
    states = S.forms(spark, sf).select(
        "q", "norm", "expansions", (F.length("q") % 4).cast("bigint").alias("n_candidates"), (F.length("q") % 3).cast("bigint").alias("n_entities"),
        F.lit("Category Search").alias("type"), F.lit(0.6).alias("confidence"),
    )
    return R.needs_rewrite(states).select("q", "triggered")


MEMORY_SQL = (
    "mem AS (SELECT q AS raw_query, q || ' x' AS rewrite, 'Category Search' AS intent, 'user' AS scope, CAST(length(q) % 5 AS BIGINT) AS accepted_count, "
    "CAST(length(q) % 3 AS BIGINT) AS rejected_count, CASE length(q) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'candidate' ELSE 'rejected' END AS status FROM forms)"
)


@query(
    "c12_lookup_aliases",
    d.with_(
        d.form_ctes() + [
            MEMORY_SQL,
            f"u AS (SELECT *, {d.norm('raw_query')} AS n FROM mem WHERE status <> 'rejected' AND accepted_count >= rejected_count)",
            f"b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY n ORDER BY CASE status WHEN 'approved' THEN 2 ELSE 1 END DESC, accepted_count - rejected_count DESC, {d.norm('rewrite')}, scope) = 1)",
        ],
        f"SELECT n AS norm, rewrite, intent, scope, status, {d.round3('least(0.96::DOUBLE, 0.74::DOUBLE + greatest(0, accepted_count - rejected_count) * 0.02::DOUBLE)')} AS confidence FROM b WHERE n IN (SELECT norm FROM forms)",
    ),
)
def c12(spark, sf):
    f = S.forms(spark, sf)
    status = F.when(F.length("q") % 3 == 0, "approved").when(F.length("q") % 3 == 1, "candidate").otherwise("rejected")
    memory = f.select(
        c("q").alias("raw_query"), F.concat("q", F.lit(" x")).alias("rewrite"), F.lit("Category Search").alias("intent"), F.lit("user").alias("scope"),
        (F.length("q") % 5).cast("bigint").alias("accepted_count"), (F.length("q") % 3).cast("bigint").alias("rejected_count"), status.alias("status"),
    )
    return R.lookup_aliases(f, memory)


@query(
    "c13_lookup_compact_forms",
    d.with_(
        d.form_ctes() + [
            f"s AS (SELECT DISTINCT norm, {d.flat('norm')} AS x FROM forms)", f"h AS (SELECT norm, x, {_partials()} AS i FROM s)",
            "t(i, compact, first, intent, conf) AS (VALUES " + ", ".join(f"({i}, {d.lit(f[0])}, {d.lit(f[1][0])}, {d.lit(f[2])}, {f[6]}::DOUBLE)" for i, f in enumerate(COMPACT_FORMS)) + ")",
        ],
        f"SELECT norm, first AS rewrite, intent, {d.round3('CASE WHEN h.i >= 100 THEN least(conf, 0.72::DOUBLE + length(x) / length(compact)::DOUBLE * 0.18::DOUBLE) ELSE conf END')} AS confidence FROM h JOIN t ON t.i = h.i % 100",
    ),
)
def c13(spark, sf):
    return R.lookup_compact_forms(S.forms(spark, sf)).select("norm", F.get("rewrites", F.lit(0)).alias("rewrite"), "intent", "confidence")


@query(
    "c14_apply_rewrites",
    d.with_(
        d.form_ctes() + [
            "p AS (SELECT q, 'Category Search' AS type, 0.5::DOUBLE + CAST(length(q) % 5 AS DOUBLE) / 10 AS conf, CASE WHEN length(q) % 7 = 0 THEN 'Ambiguous' ELSE 'Nearby Search' END AS pt, 0.7::DOUBLE + CAST(length(q) % 3 AS DOUBLE) / 10 AS pc FROM forms)",
        ],
        f"SELECT q, CASE WHEN use THEN pt ELSE type END AS type, CASE WHEN use THEN {d.round3('least(0.98::DOUBLE, greatest(conf, pc * 0.96::DOUBLE))')} ELSE conf END AS confidence FROM (SELECT *, pt <> 'Ambiguous' AND pc >= 0.8::DOUBLE AND pc >= conf AS use FROM p)",
    ),
)
def c14(spark, sf):
    f = S.forms(spark, sf).select(c("q").alias("request_id"))
    size = F.length("request_id")
    predicted = f.select("request_id", F.lit("Category Search").alias("type"), (0.5 + (size % 5).cast("double") / 10).alias("confidence"))
    proposals = f.select(
        "request_id", F.when(size % 7 == 0, "Ambiguous").otherwise("Nearby Search").alias("intent"), (0.7 + (size % 3).cast("double") / 10).alias("confidence")
    )
    return R.override_intent(predicted, proposals).select(c("request_id").alias("q"), "type", "confidence")


REWRITE_CYCLE = ["cafe vincom", "ca phe", "a much longer rewrite than the original could ever justify", "khach san"]


def _proposal_expr(dialect: str) -> str:
    from prefixlake.sources.tables import pick

    text = "VARCHAR" if dialect == "duck" else "STRING"
    return (
        "'{\"rewrites\": [\"' || " + pick("event_id", REWRITE_CYCLE) + " || '\"], \"intent\": \"' || CASE WHEN event_type = 'error' THEN 'Wrong' ELSE 'Category Search' END "
        f"|| '\", \"entities\": [], \"confidence\": ' || CAST(CAST(value / 100 AS DOUBLE) AS {text}) || ', \"evidence\": [' || CASE WHEN event_type = 'view' THEN '' ELSE '\"seen\"' END || ']}}'"
    ).replace("']}}'", "']}'")


_CLAIMS = " OR ".join(f"(contains(r, {d.lit(t)}) AND NOT contains(o, {d.lit(t)}))" for t in PROTECTED_TERMS)


@query(
    "c15_validate_proposals",
    "WITH e AS (SELECT event_id, event_type, value, " + __import__("prefixlake.sources.tables", fromlist=["pick"]).pick("event_id", REWRITE_CYCLE) + f" AS r, {d.norm('event_type')} AS o FROM events) "
    "SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'unsupported intent: Wrong' END, CASE WHEN value / 100 > 1 THEN 'confidence must be between 0 and 1' END, "
    "CASE WHEN event_type = 'view' THEN 'evidence is required' END, CASE WHEN length(r) > greatest(length(o) * 3, length(o) + 12) THEN 'rewrite is unreasonably longer than the original query' END, "
    f"CASE WHEN {_CLAIMS} THEN 'rewrite introduces unrelated brand or place evidence' END], lambda x: x IS NOT NULL), '; ') AS errors FROM e",
)
def c15(spark, sf):
    raw = table(spark, sf, "events").selectExpr("event_id", "event_type AS query", f"{_proposal_expr('spark')} AS payload")
    checked = R.validate_proposals(raw.select("query", "payload").distinct())
    return raw.join(checked, ["query", "payload"]).select("event_id", F.concat_ws("; ", "errors").alias("errors"))



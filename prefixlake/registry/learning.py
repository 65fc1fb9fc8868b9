"""Registered queries of evaluation and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators import evaluate as E
from prefixlake.operators import learn as L
from prefixlake.operators import rank as K
from prefixlake.registry import duck as d
from prefixlake.registry import shared as S
from prefixlake.registry.core import held, query, table
from prefixlake.registry.ranking import DEDUPED, PRIORITY, deduped
from prefixlake.rules import FACTORS, LEARNED_WEIGHTS, PRESETS

c = F.col
CASE_SQL = (
    "p_brand || '-' || p_type AS case_id, CASE p_type WHEN 'ECONOMY' THEN 'Brand Suggestions' WHEN 'SMALL' THEN 'Category' WHEN 'MEDIUM' THEN 'nearby' WHEN 'PROMO' THEN 'POI' ELSE 'Discovery' END AS expected_type, "
    "CASE p_type WHEN 'ECONOMY' THEN 'Easy' WHEN 'SMALL' THEN 'Medium' ELSE 'Hard' END AS difficulty"
)
INTENT_OF = "CASE expected_type WHEN 'Brand Suggestions' THEN 'Brand Search' WHEN 'Category' THEN 'Category Search' WHEN 'nearby' THEN 'Nearby Search' WHEN 'POI' THEN 'POI Search' ELSE 'Discovery Search' END"
CASES = DEDUPED + [
    f"cs AS MATERIALIZED (SELECT {CASE_SQL}, list(DISTINCT p_name) FILTER (WHERE p_size >= 42) AS expected, CASE WHEN count(*) % 2 = 0 THEN 'Brand Search' ELSE 'POI Search' END AS intent_type FROM part GROUP BY ALL)",
    f"sg AS MATERIALIZED (SELECT request_id AS case_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, {PRIORITY}, first_seen) AS rank, p_partkey, nt FROM dd)",
    f"ex AS (SELECT case_id, {d.norm('e')} AS e FROM (SELECT case_id, unnest(expected) AS e FROM cs))",
    "br AS (SELECT sg.case_id, min(rank) AS best FROM sg JOIN ex USING (case_id) WHERE rank <= 8 AND (contains(nt, e) OR contains(e, nt)) GROUP BY sg.case_id)",
    f"cr AS MATERIALIZED (SELECT cs.case_id, difficulty, {INTENT_OF} AS expected_intent, intent_type, coalesce(best, 0) AS best_rank, coalesce(1.0::DOUBLE / best, 0) AS reciprocal_rank, intent_type = {INTENT_OF} AS intent_hit, coalesce(best <= 1, false) AS top1, coalesce(best <= 3, false) AS top3, coalesce(best <= 5, false) AS top5 FROM cs LEFT JOIN br USING (case_id))",
]


def cases(spark, sf) -> DataFrame:
    """One case per brand and type, expecting the larger parts' names."""
    rows = table(spark, sf, "part").selectExpr("p_name", "p_size", *[x.strip() for x in _columns(CASE_SQL)])
    return rows.groupBy("case_id", "expected_type", "difficulty").agg(
        F.collect_set(F.when(c("p_size") >= 42, c("p_name"))).alias("expected"), F.when(F.count("*") % 2 == 0, "Brand Search").otherwise("POI Search").alias("intent_type")
    )


def _columns(text: str) -> list[str]:
    from prefixlake.registry.ranking import _split

    return _split(text)


def suggestions(spark, sf, k: int) -> DataFrame:
    return K.top_k(deduped(spark, sf), k).withColumnRenamed("request_id", "case_id")


def results(spark, sf) -> DataFrame:
    def build():
        rows = cases(spark, sf)
        return E.case_results(suggestions(spark, sf, 8), rows, rows.select("case_id", "intent_type"))

    return held(spark, sf, "k1", build)


@query("k1_case_results", d.with_(CASES, "SELECT case_id, difficulty, expected_intent, best_rank, round(reciprocal_rank, 9) AS reciprocal_rank, intent_hit, top1, top3, top5 FROM cr"))
def k1(spark, sf):
    return results(spark, sf).select("case_id", "difficulty", "expected_intent", "best_rank", F.round("reciprocal_rank", 9).alias("reciprocal_rank"), "intent_hit", "top1", "top3", "top5")


RATIO = lambda x: d.round3(f"sum(CASE WHEN {x} THEN 1 ELSE 0 END) / count(*)::DOUBLE")


@query(
    "k2_summarize",
    d.with_(CASES, f"SELECT count(*) AS total, {RATIO('top1')} AS top1_accuracy, {RATIO('top3')} AS top3_recall, {RATIO('top5')} AS top5_recall, {RATIO('intent_hit')} AS intent_accuracy, {d.round3('avg(reciprocal_rank)')} AS mrr, "
            f"{d.round3('avg(length(case_id))')} AS avg_latency, quantile_disc(length(case_id), 0.95) AS p95_latency, max(length(case_id)) AS max_latency FROM cr"),
)
def k2(spark, sf):
    return E.summarize(results(spark, sf).withColumn("ms", F.length("case_id")), "ms")


@query(
    "k3_breakdown",
    d.with_(
        CASES + [f"g AS (SELECT difficulty, expected_intent, GROUPING(difficulty) AS gd, GROUPING(expected_intent) AS gi, count(*) AS total, {RATIO('top3')} AS top3_recall, {RATIO('intent_hit')} AS intent_accuracy FROM cr GROUP BY GROUPING SETS ((), (difficulty), (expected_intent)))"],
        "SELECT CASE WHEN gd = 1 AND gi = 1 THEN 'all' WHEN gd = 0 THEN 'difficulty' ELSE 'expected_intent' END AS dimension, coalesce(difficulty, expected_intent, 'all') AS bucket, total, top3_recall, intent_accuracy FROM g",
    ),
)
def k3(spark, sf):
    return E.breakdown(results(spark, sf))


def _variants(spark, sf):
    asked = S.forms(spark, sf).select(c("q").alias("case_id"), c("q").alias("input_prefix"))
    return E.robustness_cases(asked, S.catalog(spark, sf).abbreviations)


def _abbreviated() -> str:
    from prefixlake.functions.text import plain
    from prefixlake.sources.tables import NATION_ABBREVIATIONS

    out = "' ' || n || ' '"
    rules = [(a, e) for a, e, _ in NATION_ABBREVIATIONS] + [(f"n{i}", f"NATION_{i}") for i in range(len(NATION_ABBREVIATIONS), 25)]
    for short, long in rules:
        # each long form occurs at most once per query here, so replacing all equals replacing the first
        out = f"replace({out}, {d.lit(' ' + plain(long) + ' ')}, {d.lit(' ' + plain(short) + ' ')})"
    return f"trim({out})"


LAST = "(string_split(n, ' ')[-1])"
VARIANTS = d.form_ctes() + [
    "b AS (SELECT q, norm AS n FROM forms)",
    f"v AS (SELECT q, 'accentless' AS transform, {d.unaccent('q')} AS variant FROM b UNION ALL SELECT q, 'compact', {d.flat('n')} FROM b UNION ALL SELECT q, 'uppercase', upper(q) FROM b "
    "UNION ALL SELECT q, 'spaced', regexp_replace(q, '\\s+', '  ', 'g') FROM b "
    f"UNION ALL SELECT q, 'truncated', left(n, length(n) - length({LAST})) || left({LAST}, greatest(2, CAST(floor(length({LAST}) * 0.65::DOUBLE) AS INT))) FROM b WHERE length({LAST}) > 3 "
    f"UNION ALL SELECT q, 'abbreviation', {_abbreviated()} FROM b WHERE {_abbreviated()} <> n)",
]


@query("k4_robustness_cases", d.with_(VARIANTS, f"SELECT DISTINCT q AS source_case, transform, variant FROM v WHERE length({d.norm('variant')}) >= 2 AND variant <> q"))
def k4(spark, sf):
    return _variants(spark, sf).select("source_case", "transform", "variant")


@query(
    "k5_robustness_report",
    d.with_(
        VARIANTS + [f"r AS (SELECT DISTINCT q, transform, variant, length(variant) % 3 <> 0 AS top3, length(variant) % 4 <> 0 AS top5 FROM v WHERE length({d.norm('variant')}) >= 2 AND variant <> q)"],
        f"SELECT coalesce(transform, 'all') AS transform, count(*) AS total, {RATIO('top3')} AS top3_recall, {RATIO('top5')} AS top5_recall FROM r GROUP BY ROLLUP (transform)",
    ),
)
def k5(spark, sf):
    judged = _variants(spark, sf).withColumn("top3", F.length("variant") % 3 != 0).withColumn("top5", F.length("variant") % 4 != 0)
    return E.robustness_report(judged)


TRAIN = CASES + [
    "ty AS (SELECT p_partkey, type FROM ca)",
    f"tr AS MATERIALIZED (SELECT sg.case_id, rank, sg.p_partkey, CASE WHEN len(list_filter(expected, lambda x: contains(nt, {d.norm('x')}) OR contains({d.norm('x')}, nt))) > 0 THEN 3 WHEN type = {INTENT_OF} THEN 1 ELSE 0 END AS label, "
    + ", ".join(f"f_{n}" for n in FACTORS) + " FROM sg JOIN cs USING (case_id) JOIN ty ON ty.p_partkey = sg.p_partkey JOIN fa ON fa.p_partkey = sg.p_partkey WHERE rank <= 12)",
]


def training(spark, sf) -> DataFrame:
    return held(spark, sf, "k6", lambda: L.training_rows(suggestions(spark, sf, 12).select("case_id", "rank", "text", "type", "factors", "p_partkey"), cases(spark, sf)))


@query("k6_training_rows", d.with_(TRAIN, "SELECT case_id, rank, label FROM tr"))
def k6(spark, sf):
    return training(spark, sf).select("case_id", "rank", "label")


@query(
    "k7_pairwise_deltas",
    d.with_(
        TRAIN + ["dl AS (SELECT " + ", ".join(f"round(h.f_{n} - l.f_{n}, 6) + 0.0 AS {n.lower()}" for n in FACTORS) + ", round((h.label - l.label) / 3.0::DOUBLE, 6) AS weight FROM tr h JOIN tr l ON h.case_id = l.case_id AND h.label > l.label)"],
        "SELECT " + ", ".join(n.lower() for n in FACTORS) + ", weight, count(*) AS n FROM dl GROUP BY ALL",
    ),
)
def k7(spark, sf):
    rounded = L.pairwise_deltas(training(spark, sf)).select(*[(F.round(n, 6) + 0.0).alias(n.lower()) for n in FACTORS], F.round("weight", 6).alias("weight"), "n")
    return rounded.groupBy(*[n.lower() for n in FACTORS], "weight").agg(F.sum("n").alias("n"))


@query("k8_fit_pairwise")
def k8(spark, sf):
    weights = L.fit_pairwise(L.pairwise_deltas(training(spark, sf)))
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "factor string, weight double")


def _metrics_sql(weights: dict[str, float], extra: str = "") -> str:
    score = " + ".join(f"f_{n} * {weights[n]!r}::DOUBLE" for n in FACTORS)
    return (
        f"SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY round({score}, 9) DESC, rank) AS place, row_number() OVER (PARTITION BY case_id ORDER BY label DESC) AS ideal{extra} FROM tr"
    )


GAINS = (
    "SELECT {k}case_id, min(CASE WHEN label = 3 THEN place END) AS first, sum(CASE WHEN place <= 5 THEN (pow(2, label) - 1) / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN (pow(2, label) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg FROM pl GROUP BY ALL"
)
SUMS = (
    f"count(*) AS total, {d.round3('sum(CASE WHEN first <= 1 THEN 1 ELSE 0 END) / count(*)::DOUBLE')} AS top1_accuracy, {d.round3('sum(CASE WHEN first <= 3 THEN 1 ELSE 0 END) / count(*)::DOUBLE')} AS top3_recall, "
    f"{d.round3('avg(coalesce(1.0::DOUBLE / first, 0))')} AS mrr, {d.round3('avg(CASE WHEN idcg > 0 THEN ' + d.round3('dcg / idcg') + ' ELSE 0 END)')} AS ndcg_at5"
)


@query("k9_ranking_metrics", d.with_(TRAIN + [f"pl AS ({_metrics_sql(LEARNED_WEIGHTS)})", f"cm AS ({GAINS.format(k='')})"], f"SELECT {SUMS} FROM cm"))
def k9(spark, sf):
    return L.ranking_metrics(training(spark, sf), LEARNED_WEIGHTS)


_arms = " UNION ALL ".join(f"({_metrics_sql(w, f', {d.lit(name)} AS preset')})" for name, w in PRESETS.items())


@query("k10_compare_presets", d.with_(TRAIN + [f"pl AS ({_arms})", f"cm AS ({GAINS.format(k='preset, ')})"], f"SELECT preset, {SUMS} FROM cm GROUP BY preset"))
def k10(spark, sf):
    return L.compare_presets(training(spark, sf))


WEAK = CASES + ["wk AS MATERIALIZED (SELECT * FROM cr WHERE NOT top1 OR NOT intent_hit OR NOT top3)"]


def weak(spark, sf) -> DataFrame:
    return E.weak_cases(results(spark, sf), suggestions(spark, sf, 8))


@query(
    "k11_weak_cases",
    d.with_(
        WEAK,
        "SELECT case_id, array_to_string(list_filter([CASE WHEN NOT intent_hit THEN 'intent mismatch: expected ' || expected_intent || ', predicted ' || intent_type END, CASE WHEN NOT top1 THEN 'expected suggestion was not ranked first' END, "
        "CASE WHEN NOT top3 THEN 'expected suggestion missed top 3' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM wk",
    ),
)
def k11(spark, sf):
    return weak(spark, sf).select("case_id", F.array_join("reasons", "; ").alias("reasons"))


@query("k12_tuning_proposals")
def k12(spark, sf):
    asked = cases(spark, sf).withColumn("input_prefix", F.lower("case_id"))
    return L.tuning_proposals(weak(spark, sf), asked, suggestions(spark, sf, 8), S.catalog(spark, sf))


@query(
    "k13_summarize_vector_path",
    d.with_(
        CASES + ["pv AS (SELECT *, CASE WHEN length(case_id) % 2 = 0 THEN 'minilm' ELSE 'lexical-fallback' END AS provider FROM cr)"],
        f"SELECT provider, count(*) AS total, CAST(sum(CASE WHEN length(case_id) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS degraded, {RATIO('top1')} AS top1_accuracy, {RATIO('top3')} AS top3_recall, {RATIO('intent_hit')} AS intent_accuracy, {d.round3('avg(reciprocal_rank)')} AS mrr FROM pv GROUP BY provider",
    ),
)
def k13(spark, sf):
    rows = results(spark, sf)
    providers = rows.select("case_id", F.when(F.length("case_id") % 2 == 0, "minilm").otherwise("lexical-fallback").alias("provider"), (F.length("case_id") % 3 == 0).alias("degraded"))
    return E.summarize_vector_path(rows, providers)

"""Evaluation: case results, summaries, breakdowns, robustness sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.match import expected_intent, expected_match
from prefixlake.functions.num import round3
from prefixlake.functions.text import normalize_text, strip_accents, words


def case_results(suggestions: DataFrame, cases: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """One row per case: best rank over expected x actual, hits, reciprocal rank, intent hit.

    ``suggestions`` is (case_id, rank, text), ``cases`` (case_id, expected array, expected_type,
    difficulty), ``intents`` (case_id, intent_type).
    """
    wanted = cases.select("case_id", F.explode("expected").alias("e")).select("case_id", normalize_text(F.col("e")).alias("e"))
    actual = suggestions.select("case_id", "rank", normalize_text(F.col("text")).alias("a"))
    best = (
        actual.join(wanted, "case_id").filter(expected_match(F.col("a"), F.col("e")))
        .groupBy("case_id").agg(F.min("rank").cast("int").alias("best_rank"))
    )
    out = cases.select("case_id", "difficulty", expected_intent(F.col("expected_type")).alias("expected_intent")).join(best, "case_id", "left")
    if intents is not None:
        out = out.join(intents.select("case_id", "intent_type"), "case_id", "left")
    else:
        out = out.withColumn("intent_type", F.lit(None).cast("string"))
    hit = lambda k: F.coalesce(F.col("best_rank") <= k, F.lit(False))
    return out.select(
        "case_id", "difficulty", "expected_intent", "intent_type", F.coalesce("best_rank", F.lit(0)).alias("best_rank"),
        F.when(F.col("best_rank").isNotNull(), 1.0 / F.col("best_rank")).otherwise(0.0).alias("reciprocal_rank"),
        F.coalesce(F.col("intent_type") == F.col("expected_intent"), F.lit(False)).alias("intent_hit"),
        hit(1).alias("top1"), hit(3).alias("top3"), hit(5).alias("top5"),
    )


def _ratio(flag: str) -> Column:
    return round3(F.sum(F.col(flag).cast("int")) / F.count("*"))


def summarize(results: DataFrame, latency: str | None = None) -> DataFrame:
    """One row of accuracy figures; latency figures when a latency column is named."""
    aggs = [
        F.count("*").alias("total"), _ratio("top1").alias("top1_accuracy"), _ratio("top3").alias("top3_recall"),
        _ratio("top5").alias("top5_recall"), _ratio("intent_hit").alias("intent_accuracy"), round3(F.avg("reciprocal_rank")).alias("mrr"),
    ]
    if latency:
        aggs += [
            round3(F.avg(latency)).alias("avg_latency"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})").alias("p95_latency"),
            F.max(latency).alias("max_latency"),
        ]
    return results.agg(*aggs)


def breakdown(results: DataFrame) -> DataFrame:
    """Totals overall, per difficulty and per expected intent, by grouping sets."""
    return (
        results.groupingSets([[], ["difficulty"], ["expected_intent"]], "difficulty", "expected_intent")
        .agg(
            F.grouping_id().alias("g"), F.count("*").alias("total"), _ratio("top3").alias("top3_recall"), _ratio("intent_hit").alias("intent_accuracy"),
        )
        .select(
            F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "difficulty").otherwise("expected_intent").alias("dimension"),
            F.when(F.col("g") == 3, "all").otherwise(F.coalesce("difficulty", "expected_intent")).alias("bucket"),
            "total", "top3_recall", "intent_accuracy",
        )
    )


def summarize_vector_path(results: DataFrame, providers: DataFrame) -> DataFrame:
    """Accuracy per vector provider with the number of degraded cases.

    ``providers`` is (case_id, provider, degraded).
    """
    return results.join(providers, "case_id").groupBy("provider").agg(
        F.count("*").alias("total"), F.sum(F.col("degraded").cast("int")).alias("degraded"), _ratio("top1").alias("top1_accuracy"),
        _ratio("top3").alias("top3_recall"), _ratio("intent_hit").alias("intent_accuracy"), round3(F.avg("reciprocal_rank")).alias("mrr"),
    )


def robustness_cases(cases: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Perturbed copies of each case: accentless, compact, uppercase, spaced, truncated, abbreviated.

    ``cases`` is (case_id, input_prefix). Unchanged, too short and repeated variants are dropped.
    """
    rules = (
        abbreviations.select(
            F.col("row_ord").cast("bigint").alias("row_ord"), normalize_text(F.col("expanded_form")).alias("long"),
            normalize_text(F.col("abbreviation")).alias("short"),
        ).filter("long <> '' and short <> ''")
        .agg(F.array_sort(F.collect_list(F.struct("row_ord", "long", "short"))).alias("rules"))
    )
    text, norm = F.col("input_prefix"), F.col("norm")
    tokens = words(norm)
    last = F.element_at(tokens, -1)
    cut = F.greatest(F.lit(2), F.floor(F.length(last) * 0.65).cast("int"))
    truncated = F.when(
        F.length(last) > 3, F.array_join(F.concat(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.array(F.left(last, cut))), " ")
    )

    def swap(t: Column, r: Column) -> Column:
        needle = F.concat(F.lit(" "), r["long"], F.lit(" "))
        at = F.position(needle, t)
        return F.when(
            at > 0,
            F.concat(F.substr(t, F.lit(1), at - 1), F.lit(" "), r["short"], F.lit(" "), F.substr(t, at + F.length(r["long"]) + 2)),
        ).otherwise(t)

    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    prepared = cases.select("case_id", "input_prefix").withColumn("norm", normalize_text(text)).withColumn("rules", rules.scalar())
    prepared = prepared.withColumn("short_form", F.aggregate("rules", padded, swap))
    variant = lambda name, value: F.struct(F.lit(name).alias("transform"), value.alias("variant"))
    options = F.array(
        variant("accentless", strip_accents(text)), variant("compact", F.replace(norm, F.lit(" "), F.lit(""))),
        variant("uppercase", F.upper(text)), variant("spaced", F.regexp_replace(text, "\\s+", "  ")), variant("truncated", truncated),
        variant("abbreviation", F.when(F.col("short_form") != padded, F.trim("short_form"))),
    )
    return (
        prepared.select("case_id", "input_prefix", F.explode(options).alias("v")).select("case_id", "input_prefix", "v.*")
        .filter(F.col("variant").isNotNull() & (F.length(normalize_text(F.col("variant"))) >= 2) & (F.col("variant") != F.col("input_prefix")))
        .select(F.concat_ws("-", "case_id", "transform").alias("variant_id"), F.col("case_id").alias("source_case"), "transform", "variant")
        .dropDuplicates(["source_case", "transform", "variant"])
    )


def robustness_report(results: DataFrame) -> DataFrame:
    """Recall per transform and overall, by rollup over (transform)."""
    return results.rollup("transform").agg(
        F.count("*").alias("total"), _ratio("top3").alias("top3_recall"), _ratio("top5").alias("top5_recall")
    ).withColumn("transform", F.coalesce("transform", F.lit("all")))


def weak_cases(results: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Cases that miss intent, first or top three, with reasons and their first suggestion."""
    first = suggestions.filter("rank = 1").select("case_id", F.col("text").alias("top_text"), F.col("score").alias("top_score"))
    reasons = F.array_compact(
        F.array(
            F.when(
                ~F.col("intent_hit"),
                F.concat(F.lit("intent mismatch: expected "), "expected_intent", F.lit(", predicted "), F.coalesce("intent_type", F.lit(""))),
            ),
            F.when(~F.col("top1"), F.lit("expected suggestion was not ranked first")),
            F.when(~F.col("top3"), F.lit("expected suggestion missed top 3")),
        )
    )
    return results.filter("not top1 or not intent_hit or not top3").join(first, "case_id", "left").withColumn("reasons", reasons)

"""Personalization from selection events and rule profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefixlake.functions.num import clamp01, round3
from prefixlake.functions.text import normalize_text, plain
from prefixlake.operators.cities import behavior_city_key, city_key
from prefixlake.rules import PROFILES

TERM_FIELDS = ["query", "selected_text", "selected_type", "brand", "category", "city"]


def recency_weight(ts: Column, now: Column, days: float = 14.0) -> Column:
    """exp(-age/days); future events count as age zero, unreadable dates as weight one."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.try_cast("timestamp"))) / 86_400_000_000.0)
    return F.coalesce(F.exp(-age / days), F.lit(1.0))


def event_terms(events: DataFrame) -> DataFrame:
    """One row per event and usable term: user, city, ingest_seq, slot, label, term."""
    listed = F.array(*[F.col(c) for c in TERM_FIELDS])
    return (
        events.select("user_id", "city", "ingest_seq", "occurred_at", F.posexplode(listed).alias("slot", "label"))
        .filter(F.coalesce("label", F.lit("")) != "").withColumn("term", normalize_text(F.col("label"))).filter("length(term) >= 3")
    )


def latest_events(events: DataFrame, n: int = 120) -> DataFrame:
    """The latest ``n`` events of each user, by arrival."""
    order = W.partitionBy("user_id").orderBy(F.desc("ingest_seq"))
    return events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def user_terms(events: DataFrame, scopes: DataFrame, now: Column, last_n: int = 80) -> DataFrame:
    """Decayed term weights per (user_key, scope).

    ``scopes`` lists the wanted (user_key, scope) pairs, scope being a city key or ''. Events
    of other cities are left out before the latest ``last_n`` are taken.
    """
    keyed = events.withColumn("user_key", normalize_text(F.col("user_id"))).withColumn(
        "event_city", F.when(F.coalesce("city", F.lit("")) != "", behavior_city_key(normalize_text(F.col("city"))))
    )
    scoped = keyed.join(scopes.select("user_key", "scope").distinct(), "user_key").filter(
        (F.col("scope") == "") | F.col("event_city").isNull() | (F.col("event_city") == F.col("scope"))
    )
    order = W.partitionBy("user_key", "scope").orderBy(F.desc("ingest_seq"))
    recent = scoped.withColumn("age_rank", F.row_number().over(order)).filter(F.col("age_rank") <= last_n)
    listed = F.array(*[F.col(c) for c in TERM_FIELDS])
    return (
        recent.withColumn("w", recency_weight(F.col("occurred_at"), now))
        .select("user_key", "scope", "age_rank", "w", F.posexplode(listed).alias("slot", "label"))
        .filter(F.coalesce("label", F.lit("")) != "").withColumn("term", normalize_text(F.col("label"))).filter("length(term) >= 3")
        .groupBy("user_key", "scope", "term")
        .agg(F.sum("w").alias("weight"), F.min_by("label", F.struct("age_rank", "slot")).alias("label"))
    )


def boost_value(total: Column, n_terms: Column, max_boost: float = 1.0) -> Column:
    frequency = F.least(F.lit(0.34), F.log1p(total) * 0.22)
    breadth = F.least(F.lit(0.24), n_terms * 0.06)
    return F.least(F.lit(max_boost), F.lit(0.36) + frequency + breadth)


def behavior_boost(cands: DataFrame, requests: DataFrame, events: DataFrame, now: Column, last_n: int = 80) -> DataFrame:
    """(request_id, cand_id, behavior_boost, behavior_labels, total_weight).

    ``cands`` is (request_id, cand_id, haystack), ``requests`` (request_id, user_id, city).
    Terms meet candidates through the user, so a candidate sees at most ``last_n`` events.
    """
    asks = requests.filter("coalesce(user_id, '') <> ''").select(
        "request_id", normalize_text(F.col("user_id")).alias("user_key"),
        F.when(F.coalesce("city", F.lit("")) != "", behavior_city_key(normalize_text(F.col("city")))).otherwise("").alias("scope"),
    )
    terms = user_terms(events, asks, now, last_n)
    per_scope = (
        cands.join(asks, "request_id").select("user_key", "scope", "haystack").distinct()
        .join(terms, ["user_key", "scope"]).filter(F.contains("haystack", F.col("term")))
        .groupBy("user_key", "scope", "haystack")
        .agg(
            F.sum("weight").alias("total_weight"), F.count("*").alias("n_terms"),
            F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("n"), "label"))).alias("ranked"),
        )
    )
    return (
        cands.join(asks, "request_id").join(per_scope, ["user_key", "scope", "haystack"])
        .select(
            "request_id", "cand_id", boost_value(F.col("total_weight"), F.col("n_terms")).alias("behavior_boost"),
            F.transform(F.slice("ranked", 1, 3), lambda x: x["label"]).alias("behavior_labels"), "total_weight",
        )
    )


def profile_rows(haystack: Column, user_id: Column, city: Column) -> Column:
    """struct(boost, reason) of the user's rule profile, or null."""
    user = normalize_text(user_id)
    out = F.when(F.lit(False), F.struct(F.lit(0.0).alias("boost"), F.lit("").alias("reason")))
    for pid, label, home, terms, reason, boost in PROFILES:
        at_home = F.lit(True)
        if home:
            at_home = (F.coalesce(city, F.lit("")) == "") | (city_key(normalize_text(city)) == plain(home))
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(haystack, F.lit(term))
        out = out.when(
            (user == plain(pid)) & at_home & hit, F.struct(F.lit(boost).alias("boost"), F.lit(f"{label}: {reason}").alias("reason"))
        )
    return out


def profile_boost(cands: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, cand_id, profile_boost, profile_reason) where a rule profile applies."""
    users = requests.filter("coalesce(user_id, '') <> ''").select("request_id", "user_id", "city")
    return (
        cands.join(users, "request_id").withColumn("p", profile_rows(F.col("haystack"), F.col("user_id"), F.col("city")))
        .filter("p is not null").select("request_id", "cand_id", F.col("p.boost").alias("profile_boost"), F.col("p.reason").alias("profile_reason"))
    )


def personalization(cands: DataFrame, requests: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Combined boost per candidate: the larger of profile and behaviour, with its reasons."""
    behaved = behavior_boost(cands, requests, events, now)
    ruled = profile_boost(cands, requests)
    both = ruled.join(behaved, ["request_id", "cand_id"], "full")
    learned = F.when(
        F.col("behavior_boost").isNotNull(),
        F.concat(F.lit("Local learner: prior result selections match "), F.array_join("behavior_labels", ", ")),
    )
    return both.select(
        "request_id", "cand_id",
        clamp01(F.greatest(F.coalesce("profile_boost", F.lit(0.0)), F.coalesce("behavior_boost", F.lit(0.0)))).alias("boost"),
        F.concat_ws("; ", "profile_reason", learned).alias("reason"),
    )


def rerank_with_behavior(
    suggestions: DataFrame, requests: DataFrame, events: DataFrame, now: Column,
    max_score_boost: float = 0.2, scale: float = 0.24, skip_personalized: bool = False,
) -> DataFrame:
    """Re-order finished suggestions by a bounded behaviour bonus.

    ``suggestions`` is (request_id, cand_id, text, haystack, score, personalization).
    """
    boosts = behavior_boost(suggestions, requests, events, now).select("request_id", "cand_id", "behavior_boost")
    joined = suggestions.join(boosts, ["request_id", "cand_id"], "left")
    active = F.col("behavior_boost").isNotNull()
    if skip_personalized:
        active = active & (F.col("personalization") <= 0)
    raised = clamp01(round3(F.col("score") + F.least(F.lit(max_score_boost), F.col("behavior_boost") * scale)))
    moved = joined.withColumn("score", F.when(active, raised).otherwise(F.col("score"))).withColumn(
        "personalization",
        F.when(active, F.least(F.lit(1.0), F.col("personalization") + F.col("behavior_boost"))).otherwise(F.col("personalization")),
    )
    order = W.partitionBy("request_id").orderBy(F.desc("score"), F.desc("personalization"), "text", "cand_id")
    return moved.withColumn("rank", F.row_number().over(order)).drop("behavior_boost")


def preference_terms(events: DataFrame, n: int = 20) -> DataFrame:
    """Lower-cased brand/category/text lines of each user's last ``n`` events, oldest first."""
    line = F.lower(F.concat(F.coalesce("brand", F.lit("")), F.lit(" "), F.coalesce("category", F.lit("")), F.lit(" "), "selected_text"))
    return (
        latest_events(events, n).select("user_id", F.struct("ingest_seq", line.alias("line")).alias("x"))
        .groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("terms"))
    )



"""Learning to rank: training rows, pairwise deltas, weight fit, metrics, presets, proposals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefixlake.functions.match import expected_intent, expected_match
from prefixlake.functions.num import round3
from prefixlake.functions.text import let, normalize_text, squash
from prefixlake.rules import DEFAULT_WEIGHTS, FACTORS, PRESETS
from prefixlake.session import hold
from prefixlake.sources.catalog import Catalog


def training_rows(suggestions: DataFrame, cases: DataFrame) -> DataFrame:
    """Label suggestions: 3 for an expected text, 1 for the expected intent, else 0.

    ``suggestions`` is (case_id, rank, text, type, factors), ``cases`` (case_id, expected array,
    expected_type). Suggestions come from ``top_k``, so a case has at most twelve rows.
    """
    wanted = cases.select(
        "case_id", F.transform("expected", normalize_text).alias("expected"), expected_intent(F.col("expected_type")).alias("expected_intent")
    )
    hit = let(normalize_text(F.col("text")), lambda n: F.exists("expected", lambda e: expected_match(n, e)))
    label = F.when(hit, 3).when(F.col("type") == F.col("expected_intent"), 1).otherwise(0)
    return suggestions.join(wanted, "case_id").select("case_id", "rank", "text", "type", label.alias("label"), "factors")


def pairwise_deltas(rows: DataFrame) -> DataFrame:
    """Factor differences of better over worse rows of a case, equal ones collapsed: delta, weight, n.

    Rows of a case with the same label and factors are counted first, so copies never multiply.
    """
    features = [F.col(f"factors.{f}").alias(f) for f in FACTORS]
    grouped = rows.select("case_id", "label", *features).groupBy("case_id", "label", *FACTORS).agg(F.count("*").alias("n"))
    better, worse = grouped.alias("h"), grouped.alias("l")
    joined = better.join(worse, (F.col("h.case_id") == F.col("l.case_id")) & (F.col("h.label") > F.col("l.label")))
    deltas = joined.select(
        *[(F.col(f"h.{f}") - F.col(f"l.{f}")).alias(f) for f in FACTORS], ((F.col("h.label") - F.col("l.label")) / 3.0).alias("weight"),
        (F.col("h.n") * F.col("l.n")).alias("n"),
    )
    return deltas.groupBy(*FACTORS, "weight").agg(F.sum("n").alias("n"))


#: Up to so many different deltas one task holds them all (about 80 MB) and takes every step itself.
FIT_ROWS = 1_000_000


def _descend(steps: int, rate: float, l2: float):
    """All gradient steps over rows (factors, weight, n) -> one row (factor, weight) for each factor."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = np.concatenate([b.to_numpy(dtype=float) for b in batches])
        x, scale = rows[:, : len(FACTORS)], rows[:, -2] * rows[:, -1]
        total, base, pace = rows[:, -1].sum(), np.array([DEFAULT_WEIGHTS[f] for f in FACTORS], dtype=float), rate
        current = base.copy()
        for _ in range(steps):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ current, -30.0, 30.0)))
            current = np.maximum(0.0, current - pace * (((p - 1.0) * scale @ x) / total + l2 * (current - base)))
            mass = math.fsum(current)
            current = current / mass if mass > 0 else base.copy()
            pace *= 0.993
        yield pd.DataFrame({"factor": list(FACTORS), "weight": current})

    return run


def fit_pairwise(deltas: DataFrame, steps: int = 360, rate: float = 0.16, l2: float = 0.025) -> dict[str, float]:
    """Projected gradient descent of the pairwise logistic loss; returns normalized weights.

    Up to FIT_ROWS different deltas are one job: their sum of work is small, and one task takes all
    steps. Beyond, each step is one aggregate of eight sums over the stored deltas, and only those
    sums reach the driver. (A barrier stage that exchanges the sums between tasks takes about a
    second a step, longer than a job.) Without deltas the default weights stay.
    """
    data = hold(deltas)
    many, total = data.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return dict(DEFAULT_WEIGHTS)
    if many <= FIT_ROWS:
        rows = data.select(*[F.col(f).cast("double").alias(f) for f in FACTORS], F.col("weight").cast("double"), F.col("n").cast("double"))
        fitted = rows.coalesce(1).mapInPandas(_descend(steps, rate, l2), "factor string, weight double").collect()
        return {r["factor"]: r["weight"] for r in fitted}
    data = data.persist()
    current = dict(DEFAULT_WEIGHTS)
    for _ in range(steps):
        margin = sum((F.col(f) * current[f] for f in FACTORS[1:]), F.col(FACTORS[0]) * current[FACTORS[0]])
        probability = F.when(margin >= 30, 1.0).when(margin <= -30, 0.0).otherwise(1.0 / (1.0 + F.exp(-margin)))
        scale = (probability - 1.0) * F.col("weight") * F.col("n")
        sums = data.select(scale.alias("s"), *FACTORS).agg(*[F.sum(F.col("s") * F.col(f)).alias(f) for f in FACTORS]).first()
        for f in FACTORS:
            slope = sums[f] / total + l2 * (current[f] - DEFAULT_WEIGHTS[f])
            current[f] = max(0.0, current[f] - rate * slope)
        mass = math.fsum(current.values())
        current = {f: v / mass for f, v in current.items()} if mass > 0 else dict(DEFAULT_WEIGHTS)
        rate *= 0.993
    data.unpersist()
    return current


def _score(weights: dict[str, float]) -> Column:
    return sum((F.col(f"factors.{f}") * weights[f] for f in FACTORS[1:]), F.col(f"factors.{FACTORS[0]}") * weights[FACTORS[0]])


def _case_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per case: first relevant place and NDCG@5 from rows with score, label and rank (old place)."""
    by_score = W.partitionBy(*keys).orderBy(F.desc("score"), "rank")
    by_label = W.partitionBy(*keys).orderBy(F.desc("label"), F.desc("score"), "rank")
    gain = F.pow(F.lit(2.0), F.col("label")) - 1.0
    placed = scored.withColumn("place", F.row_number().over(by_score)).withColumn("ideal", F.row_number().over(by_label))
    discounted = lambda c: F.sum(F.when(F.col(c) <= 5, gain / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    return placed.groupBy(*keys).agg(
        F.min(F.when(F.col("label") == 3, F.col("place"))).alias("first"), discounted("place").alias("dcg"), discounted("ideal").alias("idcg")
    ).withColumn("ndcg", F.when(F.col("idcg") > 0, round3(F.col("dcg") / F.col("idcg"))).otherwise(0.0))


def _metric_columns() -> list[Column]:
    hit = lambda k: round3(F.sum(F.when(F.col("first") <= k, 1).otherwise(0)) / F.count("*"))
    return [
        F.count("*").alias("total"), hit(1).alias("top1_accuracy"), hit(3).alias("top3_recall"),
        round3(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"), round3(F.avg("ndcg")).alias("ndcg_at5"),
    ]


def ranking_metrics(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: top-1, top-3, MRR and NDCG@5 of rows re-ranked with the weights."""
    return _case_metrics(rows.withColumn("score", _score(weights)), ["case_id"]).agg(*_metric_columns())


def compare_presets(rows: DataFrame, presets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Metrics of every weight preset, best first. Presets are exploded in place per row."""
    presets = presets or PRESETS
    options = F.array(*[F.struct(F.lit(name).alias("preset"), _score(w).alias("score")) for name, w in presets.items()])
    scored = rows.select("*", F.explode(options).alias("o")).select("case_id", "rank", "label", "o.preset", "o.score")
    out = _case_metrics(scored, ["preset", "case_id"]).groupBy("preset").agg(*_metric_columns())
    return out.orderBy(F.desc("top3_recall"), F.desc("top1_accuracy"), F.desc("mrr"), F.desc("ndcg_at5"), "preset")


def catalog_texts(catalog: Catalog) -> DataFrame:
    """Distinct (origin, normalized text) of everything the catalog holds."""
    part = lambda df, origin, texts: df.select(F.lit(origin).alias("origin"), F.explode(texts).alias("text"))
    rows = part(catalog.pairs, "autocomplete", F.array("suggestion_text", "input_prefix")).unionByName(
        part(catalog.pois, "poi", F.concat(F.array("poi_name", "category", "brand", "address", "city"), "tags"))
    ).unionByName(part(catalog.popular, "popular-query", F.array("query_text", "region"))).unionByName(
        part(catalog.abbreviations, "abbreviation", F.array("abbreviation", "expanded_form"))
    )
    # held, or the test for empty texts normalizes every row before they become distinct
    return hold(rows.distinct()).select("origin", normalize_text(F.col("text")).alias("text")).filter("text <> ''").distinct()


def grounded_terms(terms: DataFrame, catalog: Catalog) -> DataFrame:
    """Which normalized terms share text with the catalog: (term, origin).

    Containment either way implies a shared first-trigram or whole-value key, so the join is an
    equality join on those.
    """
    from prefixlake.functions.text import grams
    from prefixlake.operators.blocking import signature_join

    all_grams = lambda c: F.concat(
        F.transform(grams(c, 3), lambda g: F.concat(F.lit("g:"), g)), F.transform(grams(c, 2), lambda g: F.concat(F.lit("g:"), g)),
        F.transform(grams(c, 1), lambda g: F.concat(F.lit("g:"), g)),
    )
    as_gram = lambda c: F.concat(F.lit("g:"), F.left(c, F.lit(3)))
    flip = lambda c: F.transform(all_grams(c), lambda g: F.regexp_replace(g, "^g:", "b:"))
    left = terms.select("term").filter("term <> ''").distinct().withColumn(
        "sigs", F.array_distinct(F.concat(F.array(as_gram(F.col("term"))), flip(F.col("term"))))
    )
    values = catalog_texts(catalog)
    right = values.select("text").distinct().withColumn(
        "sigs", F.array_distinct(F.concat(all_grams(F.col("text")), F.array(F.concat(F.lit("b:"), F.left("text", F.lit(3))))))
    )
    hits = signature_join(left, right).distinct().filter(expected_match(F.col("text"), F.col("term")))
    return hits.join(values, "text").select("term", "origin").distinct()


def tuning_proposals(weak: DataFrame, cases: DataFrame, suggestions: DataFrame, catalog: Catalog) -> DataFrame:
    """Advisory proposals drawn from weak cases: proposal, detail, n_cases, confidence."""
    expected = cases.select("case_id", F.explode("expected").alias("e")).select("case_id", normalize_text(F.col("e")).alias("term"))
    said = cases.select("case_id", squash(normalize_text(F.col("input_prefix"))).alias("flat"))
    row = lambda df, name, detail, base, step, cap: df.select(
        F.lit(name).alias("proposal"), detail.alias("detail"), F.col("n").alias("n_cases"), round3(F.least(F.lit(cap), base + F.col("n") * step)).alias("confidence")
    )
    confused = (
        weak.filter("not intent_hit").groupBy("expected_intent", "intent_type").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "expected_intent", "intent_type").limit(1)
    )
    present = (
        suggestions.join(weak.select("case_id"), "case_id", "left_semi").join(expected, "case_id")
        .filter(expected_match(normalize_text(F.col("text")), F.col("term"))).select("case_id").distinct().agg(F.count("*").alias("n"))
    )
    grounded = grounded_terms(expected, catalog).select("term").distinct()
    backed = expected.join(grounded, "term", "left_semi").select("case_id").distinct()
    misses = weak.filter("not top3").join(backed, "case_id", "left_semi").agg(F.count("*").alias("n"))
    compact = (
        weak.join(said, "case_id").filter("length(flat) >= 4").join(expected, "case_id")
        .filter(F.startswith(squash(F.col("term")), F.col("flat"))).select("case_id").distinct().join(backed, "case_id", "left_semi").agg(F.count("*").alias("n"))
    )
    hard = weak.filter("difficulty = 'Hard'").agg(F.count("*").alias("n"))
    none = F.lit("")
    out = (
        row(confused, "intent-rebalance-highest-mismatch", F.concat_ws(" <- ", "expected_intent", "intent_type"), 0.48, 0.04, 0.9)
        .unionByName(row(present, "ranking-promote-expected-present", none, 0.5, 0.025, 0.88))
        .unionByName(row(misses, "semantic-template-grounded-misses", none, 0.45, 0.05, 0.82))
        .unionByName(row(compact, "alias-memory-candidates", none, 0.5, 0.05, 0.86))
        .unionByName(row(hard, "watch-hard-cases", none, 0.72, 0.0, 0.72))
    )
    return out.filter("n_cases > 0")

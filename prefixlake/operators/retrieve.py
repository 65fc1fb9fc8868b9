"""Candidate retrieval: one DataFrame of candidates per source, all with one schema.

Text matching runs on distinct query forms and distinct catalog values; requests with the
same query share the result and are joined back at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefixlake.functions.match import (
    category_evidence,
    expand_semantic,
    is_unresolved_compact,
    place_words,
    poi_suggestion_type,
    prefix_phrase_match,
    semantic_tokens,
    strong_evidence_of,
    suggestion_type_of,
    template_match,
    weighted_token_overlap,
)
from prefixlake.functions.num import clamp01, round3
from prefixlake.functions.text import grams, has_any, lit_array, normalize_text, plain, squash, words
from prefixlake.operators.blocking import match_values, meet_queries, signature_join, stem_signatures
from prefixlake.operators.enrich import hours_of, poi_attributes, top_evidence
from prefixlake.rules import MAX_QUERY_FREQUENCY, MAX_REVIEWS, NEARBY_CAFE_REASON, SOURCE_ORDER, TEMPLATES
from prefixlake.session import few, hold
from prefixlake.sources.catalog import Catalog

POI = (
    "struct<poi_id:string,category:string,brand:string,address:string,city:string,lat:double,lon:double,"
    "quality:double,hours:string,tags:array<string>,popularity:double,rating:double,review_count:bigint>"
)
COLUMNS = [
    "request_id", "source", "src_ord", "row_ord", "id", "text", "type", "matched", "base", "freq", "boost",
    "reason", "poi",
]


def poi_struct() -> Column:
    quality = clamp01(
        (F.col("rating") / 5.0) * 0.45 + (F.col("review_count") / MAX_REVIEWS) * 0.25
        + (F.col("popularity_score") / 100.0) * 0.3
    )
    return F.struct(
        "poi_id", "category", "brand", "address", "city", F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"), quality.alias("quality"),
        hours_of(F.col("category"), F.col("tags"))["value"].alias("hours"), "tags",
        F.col("popularity_score").cast("double").alias("popularity"), F.col("rating"),
        F.col("review_count").cast("bigint").alias("review_count"),
    ).cast(POI)


def has_location() -> Column:
    return (F.coalesce("city", F.lit("")) != "") | (F.col("lat").isNotNull() & F.col("lon").isNotNull())


def candidates(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Bring a branch to the common schema; absent parts get their neutral value."""
    defaults = {"boost": F.lit(0.0), "poi": F.lit(None).cast(POI)}
    chosen = {
        "source": F.lit(source), "src_ord": F.lit(SOURCE_ORDER.index(source)), **defaults, **columns,
    }
    return df.select(
        *[
            chosen[c].cast("bigint").alias(c) if c == "row_ord" and c in chosen
            else chosen[c].alias(c) if c in chosen else F.col(c)
            for c in COLUMNS
        ]
    )


def query_forms(requests: DataFrame) -> DataFrame:
    return requests.select("q", "norm", "expanded", "tokens", "expansions").dropDuplicates(["q"])


def _contexts(requests: DataFrame) -> DataFrame:
    return few(requests.select("request_id", "q", has_location().alias("located")))


ANSWER = "array<struct<n:bigint,full:boolean,fallback:boolean>>"


def _numbered(requests: DataFrame) -> DataFrame:
    """Distinct queries with a number, which stands for them until their hits are whole."""
    return hold(query_forms(requests).withColumn("n", F.monotonically_increasing_id()))


def _field_hits(requests: DataFrame, fields: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(q, row key, ordered matches) for catalog rows with a matching field.

    ``fields`` is (key, pos, value): one row per catalog row and text field. A field travels once
    to its value, and with the numbers of the queries its value answers once to its row.
    ``more`` gives further rows (key, pos, value, answers) from the numbered queries.
    """
    spelled = fields.filter(F.coalesce("value", F.lit("")) != "").withColumn("h", normalize_text(F.col("value")))
    forms = _numbered(requests)
    answers = (
        match_values(forms, spelled).join(few(forms.select("norm", "expanded", "n")), ["norm", "expanded"])
        .groupBy("h").agg(F.collect_list(F.struct("n", "full", "fallback")).cast(ANSWER).alias("answers"))
    )
    # by estimate the exploded fields would be broadcast, however many there are
    rows = answers.join(spelled.hint("merge"), "h").select("key", "pos", "value", "answers")
    if more is not None:
        rows = rows.unionByName(more(forms))
    single = rows.repartition("key").select("key", "pos", "value", F.explode("answers").alias("a")).select("key", "pos", "value", "a.*")
    hits = single.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "full", "fallback"))).alias("hits"))
    return hits.join(few(forms), "n").drop("n")


def popular_fallback(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """For empty queries: the first five popular rows."""
    first = catalog.popular.orderBy("row_ord").limit(5)
    empty = requests.filter("norm = ''").select("request_id", F.lit(1).alias("one"))
    rows = empty.join(F.broadcast(first.withColumn("one", F.lit(1))), "one")
    return candidates(
        rows, "popular-query", id=F.col("query_id"), text=F.col("query_text"), type=F.col("intent_type"),
        matched=F.array(F.lit("popular")), base=F.lit(0.62), freq=F.col("monthly_frequency") / MAX_QUERY_FREQUENCY,
        reason=F.lit("popular search fallback"), row_ord=F.col("row_ord"),
    )


def from_pairs(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """Historical prefix/suggestion pairs whose prefix or text matches."""
    pairs = catalog.pairs
    fields = pairs.select(
        F.col("suggestion_id").alias("key"), F.posexplode(F.array("input_prefix", "suggestion_text")).alias("pos", "value")
    )
    hits = _field_hits(requests, fields).withColumn("hits", F.filter("hits", lambda x: x["full"])).filter("size(hits) > 0")
    # a pair is normalized once, not once for each query it answers
    spelled = pairs.withColumnRenamed("suggestion_id", "key").withColumns({
        "prefix": normalize_text(F.col("input_prefix")), "says_near": has_any(normalize_text(F.col("suggestion_text")), ["gan day", "gan nhat"]),
    })
    joined = hits.join(spelled.hint("shuffle_hash"), "key")
    exact = prefix_phrase_match(F.col("prefix"), F.col("norm")) | prefix_phrase_match(F.col("prefix"), F.col("expanded"))
    nearby = F.col("norm").rlike("(^| )gan( (day|nhat))?$") & F.col("says_near")
    per_query = joined.select(
        "q", "key", "suggestion_text", "suggestion_type", "query_frequency", "row_ord", nearby.alias("nearby"),
        F.transform("hits", lambda x: x["value"]).alias("matched"),
        F.least(F.lit(1.12), F.col("score") + F.when(exact, 0.16).otherwise(0.0)).alias("strength"),
    )
    rows = per_query.join(_contexts(requests), "q")
    return candidates(
        rows, "autocomplete", id=F.col("key"), text=F.col("suggestion_text"),
        type=F.when(F.col("nearby"), F.lit("Nearby Search")).otherwise(F.col("suggestion_type")),
        base=F.when(F.col("nearby") & F.col("located"), 0.58).otherwise(F.col("strength")),
        freq=F.col("query_frequency") / MAX_QUERY_FREQUENCY, reason=F.lit("historical autocomplete pair"),
        row_ord=F.col("row_ord"),
    )


COMPOSITE = 1_000_000
NEAR = COMPOSITE + 1


def nearby_categories(entities: DataFrame) -> DataFrame:
    """(q, value): confident categories of queries that also ask for something near."""
    near = entities.filter("kind = 'proximity'").select("q").distinct()
    return (
        entities.filter("kind = 'category' and confidence >= 0.8")
        .select("q", normalize_text(F.col("value")).alias("value")).join(near, "q", "left_semi")
    )


def category_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(value, evidence) where every category word has a stem-sharing evidence word."""
    wanted = left.select("value").distinct().withColumn(
        "sigs", stem_signatures(F.array(F.element_at(F.array_sort(words(F.col("value")), lambda a, b: F.length(b) - F.length(a)), 1)))
    )
    offered = right.select("evidence").distinct().withColumn("sigs", stem_signatures(words(F.col("evidence"))))
    return signature_join(wanted, offered).distinct().filter(category_evidence(F.col("evidence"), F.col("value")))


def from_pois(requests: DataFrame, catalog: Catalog, entities: DataFrame) -> DataFrame:
    """Places with a matching field, matching category words, or a nearby-category hit."""
    pois = catalog.pois
    composite = F.array_join(
        F.filter(F.concat(F.array("category", "brand", "poi_name"), "tags"), lambda x: F.coalesce(x, F.lit("")) != ""), " "
    )
    listed = F.concat(F.array("poi_name", "brand", "category", "address", "city"), "tags")
    fields = pois.select(F.col("poi_id").alias("key"), F.posexplode(listed).alias("pos", "value")).unionByName(
        pois.select(F.col("poi_id").alias("key"), F.lit(COMPOSITE).alias("pos"), composite.alias("value"))
    )
    evidence = pois.select(
        F.col("poi_id").alias("key"), normalize_text(F.concat_ws(" ", "category", "poi_name", "brand")).alias("evidence")
    )
    wanted = nearby_categories(entities)

    def near_rows(forms: DataFrame) -> DataFrame:
        asked = wanted.join(forms.select("q", "n"), "q").select("value", "n")
        answers = category_pairs(wanted, evidence).join(asked, "value").groupBy("evidence").agg(
            F.transform(F.collect_set("n"), lambda n: F.struct(n.alias("n"), F.lit(False).alias("full"), F.lit(False).alias("fallback"))).cast(ANSWER).alias("answers")
        )
        return answers.join(evidence, "evidence").select("key", F.lit(NEAR).alias("pos"), F.lit(None).cast("string").alias("value"), "answers")

    found = _field_hits(requests, fields, near_rows).select(
        "q", "key", "norm", "expanded", "tokens",
        F.transform(F.filter("hits", lambda x: x["full"] & (x["pos"] < COMPOSITE)), lambda x: x["value"]).alias("matched"),
        F.exists("hits", lambda x: x["full"] & (x["pos"] == COMPOSITE)).alias("whole"),
        F.exists("hits", lambda x: x["fallback"] & (x["pos"] == 2)).alias("by_category"),
        F.exists("hits", lambda x: x["pos"] == NEAR).alias("near"),
    ).filter("size(matched) > 0 or whole or by_category or near")
    labels = F.transform(top_evidence(poi_attributes(pois)), lambda a: a["label"])
    places = pois.select(
        F.col("poi_id").alias("key"), "poi_name", "category", "brand", "address", "city", "popularity_score", "row_ord",
        poi_struct().alias("poi"), place_words(F.col("poi_name"), F.col("category"), F.col("brand"), F.col("address")).alias("says"),
        F.when(F.size(labels) > 0, F.concat(F.lit("; enriched evidence: "), F.array_join(labels, ", ")))
        .otherwise(F.lit("")).alias("enriched"),
    )
    named = F.when(F.size("matched") > 0, F.col("matched")).when(
        F.col("whole"), F.array("category", F.when(F.col("brand") != "", F.col("brand")).otherwise(F.col("poi_name")))
    ).otherwise(F.array("category"))
    per_query = (
        found.join(places.hint("shuffle_hash"), "key")
        .select(
            "q", "key", "poi_name", "poi", "row_ord", "near", "popularity_score", named.alias("matched"),
            suggestion_type_of(F.col("says"), F.col("norm"), F.col("expanded"), F.col("tokens")).alias("type"),
            F.concat(
                F.when(F.col("near"), F.lit("nearby category expansion matched ")).otherwise(F.lit("matched ")), "category",
                F.when(F.col("city") != "", F.concat(F.lit(" in "), "city")).otherwise(F.lit("")), "enriched",
            ).alias("reason"),
        )
    )
    rows = per_query.join(_contexts(requests), "q")
    return candidates(
        rows, "poi", id=F.col("key"), text=F.col("poi_name"), row_ord=F.col("row_ord"), poi=F.col("poi"),
        base=F.when(F.col("near"), F.when(F.col("located"), 1.02).otherwise(0.82)).otherwise(0.76),
        freq=F.col("popularity_score") / 100.0, boost=F.when(F.col("near"), 0.1).otherwise(0.0),
    )


def from_popular(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """Popular queries whose text or region matches."""
    popular = catalog.popular
    fields = popular.select(
        F.col("query_id").alias("key"), F.posexplode(F.array("query_text", "region")).alias("pos", "value")
    )
    hits = _field_hits(requests, fields).withColumn("hits", F.filter("hits", lambda x: x["full"])).filter("size(hits) > 0")
    rows = (
        hits.select("q", "key", F.transform("hits", lambda x: x["value"]).alias("matched"))
        .join(popular.withColumnRenamed("query_id", "key").hint("shuffle_hash"), "key").join(_contexts(requests), "q")
    )
    return candidates(
        rows, "popular-query", id=F.col("key"), text=F.col("query_text"), type=F.col("intent_type"), base=F.lit(0.82),
        freq=F.col("monthly_frequency") / MAX_QUERY_FREQUENCY, reason=F.lit("popular query trend"), row_ord=F.col("row_ord"),
    )


# --- lexical-semantic documents ---------------------------------------------------------


def semantic_documents(catalog: Catalog, patterns: DataFrame | None = None) -> DataFrame:
    """All retrievable documents with their composed text, intent and display fields."""
    none = F.lit(None).cast("string")
    def docs(df, kind, grp, doc_id, text, intent, show, freq, poi=F.lit(None).cast(POI)):
        return df.select(
            doc_id.alias("doc_id"), F.lit(kind).alias("kind"), text.alias("text"), intent.alias("intent"), show.alias("show"),
            freq.cast("double").alias("freq"), poi.alias("poi"), F.struct(F.lit(grp).alias("grp"), F.col("row_ord").cast("bigint").alias("row")).alias("ord"),
        )

    out = docs(
        catalog.pairs, "autocomplete", 0, F.concat(F.lit("semantic-autocomplete-"), "suggestion_id"),
        F.concat_ws(" ", "input_prefix", "suggestion_text", "suggestion_type"), F.col("suggestion_type"),
        F.col("suggestion_text"), F.col("query_frequency") / MAX_QUERY_FREQUENCY,
    ).unionByName(
        docs(
            catalog.pois, "poi", 1, F.concat(F.lit("semantic-poi-"), "poi_id"),
            F.concat_ws(" ", "poi_name", "category", "brand", "address", "city", F.array_join("tags", " ")), none,
            F.col("poi_name"), F.col("popularity_score") / 100.0, poi_struct(),
        )
    ).unionByName(
        docs(
            catalog.popular, "popular-query", 2, F.concat(F.lit("semantic-popular-"), "query_id"),
            F.concat_ws(" ", "query_text", "intent_type", "region"), F.col("intent_type"), F.col("query_text"),
            F.col("monthly_frequency") / MAX_QUERY_FREQUENCY,
        )
    )
    if patterns is not None:
        out = out.unionByName(
            docs(
                patterns, "generated-pattern", 3, F.concat(F.lit("semantic-generated-"), F.col("row_ord").cast("string")),
                F.concat_ws(" ", "text", "type", F.array_join("matched", " "), "reason"), F.col("type"), F.col("text"), F.col("freq"),
            )
        )
    return out


def vector_queries(requests: DataFrame) -> DataFrame:
    """Queries that may use the similarity stages: neither empty nor an unresolved compact word."""
    return (
        query_forms(requests)
        .filter((F.col("norm") != "") & ~is_unresolved_compact(F.col("norm"), F.col("expanded"), F.col("expansions")))
        .withColumn("query", F.when(F.col("expanded") != "", F.col("expanded")).otherwise(F.col("norm")))
    )


def semantic_matches(requests: DataFrame, docs: DataFrame, k: int = 12, min_sim: float = 0.5) -> DataFrame:
    """(q, doc_id, similarity, rank): best lexical-semantic documents of each query."""
    queries = vector_queries(requests).filter("length(query) >= 4").select("q", normalize_text(F.col("query")).alias("query"))
    text = docs.select("doc_id", "ord", normalize_text(F.col("text")).alias("text"))
    long_ones = lambda tokens: F.filter(tokens, lambda t: F.length(t) >= 3)
    q_side = queries.select("query").distinct().withColumn("qx", expand_semantic(F.col("query"))).select(
        "query", semantic_tokens(F.col("qx")).alias("q_tokens"), grams(squash(F.col("qx"))).alias("q_grams")
    )
    d_side = hold(
        text.select("text").distinct().select(F.monotonically_increasing_id().alias("text_id"), "text", expand_semantic(F.col("text")).alias("dx"))
    ).withColumn("d_tokens", semantic_tokens(F.col("dx")))
    # a token with a partner shares its stem key; the sums of such tokens bound the score, shared trigrams are exact
    item = lambda key, mass, hits, shared: F.struct(key.alias("key"), mass.alias("mass"), hits.alias("hits"), shared.alias("shared"))
    token = lambda t: item(F.get(stem_signatures(F.array(t)), F.lit(0)), F.when(F.length(t) >= 5, 1.25).otherwise(1.0), F.lit(1), F.lit(0))
    gram = lambda g: item(F.concat(F.lit("g:"), g), F.lit(0.0), F.lit(0), F.lit(1))
    probes = q_side.select("query", F.explode(F.concat(F.transform(long_ones("q_tokens"), token), F.transform("q_grams", gram))).alias("x"))
    probes = probes.groupBy("query", "x.key").agg(*[F.sum(f"x.{c}").alias(c) for c in ("mass", "hits", "shared")])
    features = (
        d_side.select("text_id", "d_tokens", grams(squash(F.col("dx"))).alias("d_grams")).select(
            "text_id", F.size("d_grams").alias("n_grams"),
            F.explode(F.concat(stem_signatures(long_ones("d_tokens")), F.transform("d_grams", lambda g: F.concat(F.lit("g:"), g)))).alias("key"),
        ).repartition("text_id")
    )
    sums = meet_queries(
        probes, "query",
        lambda part: features.join(part, "key").groupBy("text_id", "n_grams", "query").agg(*[F.sum(c).alias(c) for c in ("mass", "hits", "shared")]),
    )
    sizes = q_side.select(
        "query", "q_tokens", "q_grams", F.size(long_ones("q_tokens")).alias("n_tokens"),
        F.aggregate(long_ones("q_tokens"), F.lit(0.0), lambda s, t: s + F.when(F.length(t) >= 5, 1.25).otherwise(1.0)).alias("total"),
    )
    dice = F.when((F.size("q_grams") == 0) | (F.col("n_grams") == 0), 0.0).otherwise(F.lit(2.0) * F.col("shared") / (F.size("q_grams") + F.col("n_grams")))
    scored = (
        sums.filter("hits > 0").join(hold(sizes), "query")
        .filter((F.col("hits") >= F.least(F.lit(2), F.col("n_tokens"))) & (F.col("mass") / F.col("total") * 0.72 + dice * 0.28 >= min_sim - 0.001))
        .select("query", "text_id", "q_tokens", dice.alias("dice"))
        .join(d_side.select("text_id", "text", "d_tokens").hint("merge"), "text_id")
        .filter(strong_evidence_of(F.col("q_tokens"), F.col("d_tokens")))
        .select("query", "text", round3(F.least(F.lit(1.0), weighted_token_overlap(F.col("q_tokens"), F.col("d_tokens")) * 0.72 + F.col("dice") * 0.28)).alias("similarity"))
        .filter(F.col("similarity") >= min_sim)
    )
    best = W.partitionBy("query").orderBy(F.desc("similarity"), "ord")
    ranked = scored.join(text.hint("merge"), "text").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(queries, "query").select("q", "doc_id", "similarity", "rank")


def _document_candidates(requests, hits, docs, source, base, boost, prefix, label, matched) -> DataFrame:
    joined = (
        hits.join(docs.drop("text"), "doc_id").join(query_forms(requests), "q").join(_contexts(requests), "q")
    )
    poi_type = poi_suggestion_type(
        F.col("show"), F.col("poi.category"), F.col("poi.brand"), F.col("poi.address"),
        F.col("norm"), F.col("expanded"), F.col("tokens"),
    )
    place = F.concat(
        F.lit(f"{label} from "), "poi.category",
        F.when(F.col("poi.city") != "", F.concat(F.lit(" in "), F.col("poi.city"))).otherwise(F.lit("")),
    )
    reason = (
        F.when(F.col("kind") == "poi", place)
        .when(F.col("kind") == "autocomplete", F.lit(f"{label} from historical autocomplete"))
        .when(F.col("kind") == "popular-query", F.lit(f"{label} from popular query"))
        .otherwise(F.lit(f"{label} from generated pattern"))
    )
    return candidates(
        joined, source, id=F.concat(F.lit(prefix), "doc_id"), text=F.col("show"), row_ord=F.col("rank"),
        type=F.when(F.col("kind") == "poi", poi_type).otherwise(F.col("intent")), matched=F.array(F.lit(matched)),
        base=base, freq=F.col("freq"), boost=F.lit(boost), reason=reason, poi=F.col("poi"),
    )


def from_semantic(requests: DataFrame, docs: DataFrame, k: int = 12) -> DataFrame:
    sim, kind = F.col("similarity"), F.col("kind")
    base = (
        F.when(kind == "poi", F.least(F.lit(0.76), 0.42 + sim * 0.32))
        .when(kind == "autocomplete", F.least(F.lit(0.76), 0.43 + sim * 0.32))
        .otherwise(F.least(F.lit(0.74), 0.42 + sim * 0.3))
    )
    return _document_candidates(
        requests, semantic_matches(requests, docs, k), docs, "semantic", base, 0.02, "", "semantic match", "semantic retrieval"
    )


def from_neighbors(requests: DataFrame, neighbors: DataFrame, docs: DataFrame, k: int = 10, provider: str = "lexical-fallback") -> DataFrame:
    """Candidates from vector neighbours (q, doc_id, similarity, rank).

    Sparse neighbours need 0.44 and strong word evidence, dense ones (``minilm``) 0.42.
    """
    queries = vector_queries(requests).filter("length(query) >= 4").select("q", "query")
    near = neighbors.join(queries, "q")
    if provider == "minilm":
        kept = near.filter("similarity >= 0.42")
    else:
        from prefixlake.functions.match import strong_semantic_evidence

        kept = near.filter("similarity >= 0.44").join(docs.select("doc_id", "text"), "doc_id").filter(
            strong_semantic_evidence(normalize_text(F.col("query")), normalize_text(F.col("text")))
        )
    kept = kept.select("q", "doc_id", "similarity", F.row_number().over(W.partitionBy("q").orderBy("rank")).alias("rank"))
    sim, kind = F.col("similarity"), F.col("kind")
    base = (
        F.when(kind == "poi", F.least(F.lit(0.84), 0.48 + sim * 0.42))
        .when(kind == "autocomplete", F.least(F.lit(0.84), 0.48 + sim * 0.4))
        .when(kind == "popular-query", F.least(F.lit(0.82), 0.47 + sim * 0.38))
        .otherwise(F.least(F.lit(0.82), 0.48 + sim * 0.38))
    )
    return _document_candidates(
        requests, kept.filter(F.col("rank") <= k), docs, "embedding", base, 0.04, "embedding-", f"{provider} kNN match",
        "embedding kNN",
    )


# --- curated templates ------------------------------------------------------------------


def template_table(spark) -> DataFrame:
    """One row per template text: ord, triggers, text, type, reason."""
    rows, ord_ = [], 0
    for triggers, texts, kind, reason in TEMPLATES:
        for text in texts:
            rows.append((ord_, [plain(t) for t in triggers], triggers, text, kind, reason))
            ord_ += 1
    return spark.createDataFrame(
        rows, "row_ord bigint, triggers array<string>, labels array<string>, text string, type string, reason string"
    )


def from_templates(requests: DataFrame) -> DataFrame:
    """Curated completions whose trigger fires. The trigger list is a fixed short array, so it
    is tested in place, trigger by trigger, on distinct queries."""
    spark = requests.sparkSession
    templates = template_table(spark)
    forms = query_forms(requests).filter("norm <> ''")
    texts = forms.select(F.explode(F.array_distinct(F.array("norm", "expanded"))).alias("query")).distinct()
    fixed = lit_array(dict.fromkeys(plain(t) for group in TEMPLATES for t in group[0]))
    fired = (
        texts.select("query", F.explode(fixed).alias("trigger"))
        .filter(template_match(F.col("query"), F.col("trigger")))
    )
    slots = templates.select("row_ord", F.posexplode("triggers").alias("pos", "trigger"), "labels")
    hits = (
        fired.join(slots, "trigger")
        .join(forms.select("q", F.explode(F.array_distinct(F.array("norm", "expanded"))).alias("query")), "query")
        .groupBy("q", "row_ord").agg(F.array_sort(F.collect_set("pos")).alias("slots"))
    )
    rows = (
        hits.join(templates, "row_ord").join(forms.select("q", "norm"), "q").join(_contexts(requests), "q")
        .withColumn("matched", F.transform(F.slice("slots", 1, 2), lambda p: F.get("labels", p)))
    )
    near = (F.col("reason") == NEARBY_CAFE_REASON) & (
        has_any(F.col("norm"), ["gan day", "gan nhat"]) | F.endswith(F.col("norm"), F.lit(" gan"))
    )
    scoped = near & F.col("located")
    return candidates(
        rows, "template", id=F.concat(F.lit("template-"), F.col("row_ord").cast("string")), row_ord=F.col("row_ord"),
        type=F.when(near, F.lit("Nearby Search")).otherwise(F.col("type")), base=F.when(scoped, 0.58).otherwise(0.74),
        freq=F.lit(0.82), boost=F.when(scoped, 0.08).otherwise(0.52),
    )


def union_candidates(*branches: DataFrame) -> DataFrame:
    """All branches as one table; (src_ord, row_ord) keeps the order of appearance."""
    out = branches[0].select(*COLUMNS)
    for branch in branches[1:]:
        out = out.unionByName(branch.select(*COLUMNS))
    return out

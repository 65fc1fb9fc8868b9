"""Match predicates over normalized text.

Each takes normalized strings (or token arrays derived from them) and returns a boolean
column. Lossless blocking for them lives in ``operators.blocking``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefixlake.functions.num import round3
from prefixlake.functions.text import (
    contains_token_phrase,
    dice,
    grams,
    has_any,
    let,
    let_all,
    lit_array,
    normalize_text,
    padded,
    squash,
    words,
)
from prefixlake.rules import (
    DISCOVERY_QUERY_WORDS,
    LABEL_INTENTS,
    NEARBY_CATEGORY_WORDS,
    NEARBY_PLACE_WORDS,
    NEARBY_QUERY_WORDS,
    POI_CATEGORY_WORDS,
    SEMANTIC_EXPANSIONS,
)


def edit_within(a: Column, b: Column, n: int) -> Column:
    return F.levenshtein(a, b, n) >= 0


def token_evidence(h: Column, h_words: Column, token: Column) -> Column:
    """Three-letter tokens need a token prefix, longer ones any substring."""
    return (
        F.when(F.length(token) < 3, F.lit(False))
        .when(F.length(token) == 3, F.exists(h_words, lambda w: F.startswith(w, token)))
        .otherwise(F.contains(h, token))
    )


def token_fallback(h: Column, tokens: Column, h_words: Column | None = None) -> Column:
    def body(v: Column) -> Column:
        significant = F.filter(v["tokens"], lambda t: F.length(t) >= 3)
        return F.exists(v["tokens"], lambda t: F.length(t) >= 3) & F.forall(
            significant, lambda t: token_evidence(v["h"], v["w"], t)
        )

    return let_all(body, h=h, tokens=tokens, w=words(h) if h_words is None else h_words)


def _near_token(h: Column, h_words: Column, token: Column) -> Column:
    same_start = lambda w: (
        (F.left(w, F.lit(1)) == F.left(token, F.lit(1)))
        & (F.abs(F.length(w) - F.length(token)) <= 1)
        & edit_within(w, token, 1)
    )
    return F.when(F.length(token) <= 3, F.exists(h_words, lambda w: F.startswith(w, token))).otherwise(
        F.contains(h, token) | F.exists(h_words, same_start)
    )


def fuzzy_includes(h: Column, n: Column, h_words: Column | None = None) -> Column:
    """Equal, contained either way, or every significant needle token within one edit."""
    def body(v: Column) -> Column:
        significant = F.filter(F.split(v["n"], " "), lambda t: F.length(t) >= 3)
        by_token = let(
            significant, lambda ts: (F.size(ts) > 0) & F.forall(ts, lambda t: _near_token(v["h"], v["w"], t))
        )
        return (
            (v["n"] == "")
            | (v["h"] == v["n"])
            | ((F.length(v["n"]) >= 3) & F.contains(v["h"], v["n"]))
            | ((F.length(v["h"]) >= 3) & F.contains(v["n"], v["h"]))
            | by_token
        )

    return let_all(body, h=h, n=n, w=words(h) if h_words is None else h_words)


def prefix_phrase_match(h: Column, q: Column, h_words: Column | None = None) -> Column:
    """Some run of consecutive haystack tokens starts with the query tokens in order.

    A plain substring test rules most pairs out before any token is compared; for one-word
    queries it is the whole answer.
    """
    head = F.concat(F.lit(" "), F.element_at(F.split(q, " "), 1))

    def run(v: Column) -> Column:
        last = F.size(v["w"]) - F.size(v["qw"])
        hit = F.exists(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda s: F.forall(
                F.sequence(F.lit(0), F.size(v["qw"]) - 1),
                lambda i: F.startswith(F.get(v["w"], s + i), F.get(v["qw"], i)),
            ),
        )
        return (last >= 0) & hit

    return (
        F.when(q == "", F.lit(False))
        .when(~F.contains(F.concat(F.lit(" "), h), head), F.lit(False))
        .when(~F.contains(q, F.lit(" ")), F.lit(True))
        .otherwise(let_all(run, w=words(h) if h_words is None else h_words, qw=words(q)))
    )


def compact_cross_prefix(h: Column, compact_q: Column, h_words: Column | None = None) -> Column:
    """The compact query starts at a token and runs over at least one token boundary."""
    def run(v: Column) -> Column:
        hit = F.exists(
            F.sequence(F.lit(0), F.greatest(F.size(v["w"]) - 2, F.lit(0))),
            lambda s: (F.length(v["q"]) > F.length(F.get(v["w"], s)))
            & F.startswith(F.array_join(F.slice(v["w"], s + 1, F.size(v["w"])), ""), v["q"]),
        )
        return (F.size(v["w"]) >= 2) & hit

    return (
        F.when(F.length(compact_q) < 3, F.lit(False))
        .when(~F.contains(squash(h), compact_q), F.lit(False))
        .otherwise(let_all(run, w=words(h) if h_words is None else h_words, q=compact_q))
    )


def query_matches(h: Column, norm: Column, expanded: Column, tokens: Column) -> Column:
    """The catalog match test: any of the four text rules, on either form of the query."""
    def body(v: Column) -> Column:
        one_form = lambda q: (
            fuzzy_includes(v["h"], q, v["w"])
            | prefix_phrase_match(v["h"], q, v["w"])
            | compact_cross_prefix(v["h"], squash(q), v["w"])
        )
        short_tail = (
            F.contains(v["n"], F.lit(" "))
            & (F.length(F.substring_index(v["n"], " ", -1)) < 3)
            & (v["n"] == v["e"])
        )
        any_rule = (
            one_form(v["n"])
            | ((v["n"] != v["e"]) & one_form(v["e"]))
            | token_fallback(v["h"], v["tokens"], v["w"])
        )
        return (
            F.when(v["h"] == "", F.lit(False))
            .when(short_tail, prefix_phrase_match(v["h"], v["n"], v["w"]))
            .otherwise(any_rule)
        )

    return let_all(body, h=h, n=norm, e=expanded, tokens=tokens, w=words(h))


def significant_tokens_every(query: Column, h: Column) -> Column:
    def body(v: Column) -> Column:
        enough = (F.size(v["all"]) <= 1) | (F.size(v["long"]) >= 2)
        return enough & (F.size(v["long"]) > 0) & F.forall(
            v["long"], lambda t: token_evidence(v["h"], v["w"], t)
        )

    long_tokens = F.filter(words(query), lambda t: F.length(t) >= 3)
    return let_all(body, all=words(query), long=long_tokens, h=h, w=words(h))


def template_match(query: Column, trigger: Column) -> Column:
    """Does a trigger phrase fire for the query text (both normalized)?"""
    def body(v: Column) -> Column:
        q, t, qw, tw = v["q"], v["t"], v["qw"], v["tw"]
        unique = F.array_distinct(qw)
        joined = compact_cross_prefix(t, squash(q), tw) | (
            (F.size(unique) == 1) & compact_cross_prefix(t, F.get(unique, F.lit(0)), tw)
        )
        blocked = (F.size(qw) < 2) & (F.size(tw) > 1)
        has_short = F.exists(tw, lambda x: F.length(x) <= 2)
        loose = (
            prefix_phrase_match(t, q, tw)
            | prefix_phrase_match(q, t, qw)
            | (~has_short & fuzzy_includes(q, t, qw))
            | significant_tokens_every(q, t)
        )
        return joined | (~blocked & loose)

    return let_all(body, q=query, t=trigger, qw=words(query), tw=words(trigger))


def shares_stem(a: Column, b: Column) -> Column:
    """Equal, or one starts with the other and both have at least four letters."""
    return (a == b) | (
        (F.least(F.length(a), F.length(b)) >= 4) & (F.startswith(a, b) | F.startswith(b, a))
    )


def category_evidence(evidence: Column, category: Column) -> Column:
    return let(
        words(evidence),
        lambda ws: F.forall(words(category), lambda t: F.exists(ws, lambda e: shares_stem(e, t))),
    )


def phrase_evidence(query: Column, phrase: Column) -> Column:
    """Is a lexicon phrase present in the query, token prefixes allowed?"""
    def one(t: Column, q_words: Column) -> Column:
        return F.exists(
            q_words,
            lambda w: F.when(F.length(t) < 3, w == t).otherwise(
                F.startswith(w, t) | ((F.length(w) >= 3) & F.startswith(t, w))
            ),
        )

    def body(v: Column) -> Column:
        parts = F.when(F.size(v["raw"]) > 1, F.filter(v["raw"], lambda t: F.length(t) >= 2)).otherwise(v["raw"])
        lone_short = (F.size(v["raw"]) == 1) & (F.length(v["p"]) < 3)
        loose = let(parts, lambda ps: (F.size(ps) > 0) & F.forall(ps, lambda t: one(t, v["qw"])))
        return (v["p"] != "") & (F.contains(padded(v["q"]), padded(v["p"])) | (~lone_short & loose))

    return let_all(body, q=query, p=phrase, raw=words(phrase), qw=words(query))


def expected_match(actual: Column, expected: Column) -> Column:
    """Mutual substring of two normalized texts."""
    return F.contains(actual, expected) | F.contains(expected, actual)


# --- lexical-semantic similarity -------------------------------------------------------


def expand_semantic(norm: Column) -> Column:
    """The text followed by the related words of every known term it mentions."""
    parts = [F.array(norm)]
    for term, additions in SEMANTIC_EXPANSIONS.items():
        extra = lit_array(additions)
        parts.append(
            F.when(contains_token_phrase(norm, F.lit(term)), extra).otherwise(
                F.array().cast("array<string>")
            )
        )
    return F.array_join(F.filter(F.array_distinct(F.concat(*parts)), lambda t: t != ""), " ")


def semantic_tokens(expanded: Column) -> Column:
    return F.array_distinct(F.filter(F.split(expanded, " "), lambda t: F.length(t) >= 2))


def weighted_token_overlap(q_tokens: Column, d_tokens: Column) -> Column:
    """Share of query-token weight that the document covers; long tokens weigh more."""
    weight = lambda t: F.when(F.length(t) >= 5, F.lit(1.25)).otherwise(F.lit(1.0))
    add = lambda s, t: s + weight(t)

    def body(v: Column) -> Column:
        hits = F.filter(v["q"], lambda t: F.exists(v["d"], lambda d: shares_stem(t, d)))
        total = F.aggregate(v["q"], F.lit(0.0), add)
        return F.when((F.size(v["q"]) > 0) & (F.size(v["d"]) > 0), F.aggregate(hits, F.lit(0.0), add) / total).otherwise(
            F.lit(0.0)
        )

    return let_all(body, q=F.filter(q_tokens, lambda t: F.length(t) >= 3), d=d_tokens)


def similarity_of(q_tokens: Column, q_grams: Column, d_tokens: Column, d_grams: Column) -> Column:
    score = weighted_token_overlap(q_tokens, d_tokens) * 0.72 + dice(q_grams, d_grams) * 0.28
    return round3(F.least(F.lit(1.0), score))


def semantic_similarity(query: Column, document: Column) -> Column:
    """Blend of token overlap and trigram Dice over the expanded normalized texts."""
    def body(v: Column) -> Column:
        score = similarity_of(
            semantic_tokens(v["q"]), grams(squash(v["q"])), semantic_tokens(v["d"]), grams(squash(v["d"]))
        )
        return F.when((v["q"] == "") | (v["d"] == ""), F.lit(0.0)).otherwise(score)

    return let_all(body, q=expand_semantic(query), d=expand_semantic(document))


def strong_evidence_of(q_tokens: Column, d_tokens: Column) -> Column:
    def body(v: Column) -> Column:
        hits = F.filter(v["q"], lambda t: F.exists(v["d"], lambda d: shares_stem(t, d)))
        return F.size(hits) >= F.least(F.lit(2), F.size(v["q"]))

    return let_all(body, q=F.filter(q_tokens, lambda t: F.length(t) >= 3), d=d_tokens)


def strong_semantic_evidence(query: Column, document: Column) -> Column:
    return strong_evidence_of(
        semantic_tokens(expand_semantic(query)), semantic_tokens(expand_semantic(document))
    )


# --- labels ----------------------------------------------------------------------------


def expected_intent(c: Column) -> Column:
    """Intent named by a free-form expected-type label; the first keyword wins."""
    norm = normalize_text(c)
    out = F.when(F.lit(False), F.lit(""))
    for word, intent in LABEL_INTENTS:
        out = out.when(F.contains(norm, F.lit(word)), F.lit(intent))
    return out.otherwise(F.lit("Ambiguous"))


def category_intent(c: Column) -> Column:
    norm = normalize_text(c)
    return (
        F.when(has_any(norm, NEARBY_CATEGORY_WORDS), F.lit("Nearby Search"))
        .when(has_any(norm, POI_CATEGORY_WORDS), F.lit("POI Search"))
        .otherwise(F.lit("Category Search"))
    )


def poi_suggestion_type(
    name: Column, category: Column, brand: Column, address: Column,
    norm: Column, expanded: Column, tokens: Column,
) -> Column:
    """Suggestion type of a place for a query; ordered rules, first hit wins."""
    return suggestion_type_of(place_words(name, category, brand, address), norm, expanded, tokens)


def place_words(name: Column, category: Column, brand: Column, address: Column) -> Column:
    """What of a place decides its suggestion types: normalized once per place, not once for each query it answers."""
    n_category = normalize_text(category)
    return F.struct(
        normalize_text(F.concat_ws(" ", name, address)).alias("full"), has_any(n_category, NEARBY_PLACE_WORDS).alias("nearby"),
        F.when(F.coalesce(brand, F.lit("")) != "", words(normalize_text(brand))).alias("brand"), F.split(n_category, " ").alias("category"),
    )


def suggestion_type_of(place: Column, norm: Column, expanded: Column, tokens: Column) -> Column:
    """As :func:`poi_suggestion_type`, from the place's :func:`place_words`."""
    brand_hit = F.exists(
        place["brand"],
        lambda b: F.exists(tokens, lambda t: (F.length(t) >= 3) & F.startswith(b, t)),
    )
    # a phrase that begins words of the text begins the first of them
    begun = F.contains(F.concat(F.lit(" "), place["full"]), F.concat(F.lit(" "), F.substring_index(norm, " ", 1)))
    return (
        F.when(has_any(expanded, NEARBY_QUERY_WORDS), F.lit("Nearby Search"))
        .when(has_any(expanded, DISCOVERY_QUERY_WORDS), F.lit("Discovery Search"))
        .when(begun & prefix_phrase_match(place["full"], norm), F.lit("Address Suggestion"))
        .when(place["nearby"], F.lit("Nearby Search"))
        .when(place["brand"].isNotNull() & brand_hit, F.lit("Brand Search"))
        .when(F.exists(place["category"], lambda t: F.array_contains(tokens, t)), F.lit("Category Search"))
        .otherwise(F.lit("POI Search"))
    )


def equivalent_text(a: Column, b: Column) -> Column:
    return normalize_text(a) == normalize_text(b)


def equivalent_number(a: Column, b: Column) -> Column:
    return F.abs(a - b) < F.lit(0.000001)


def equivalent_list(a: Column, b: Column) -> Column:
    """Two string lists hold the same normalized members, order aside."""
    canonical = lambda c: F.array_sort(F.transform(c, normalize_text))
    return canonical(a) == canonical(b)


def is_unresolved_compact(norm: Column, expanded: Column, expansions: Column) -> Column:
    return (
        ~F.contains(norm, F.lit(" "))
        & (norm == expanded)
        & (F.size(expansions) == 0)
        & (F.length(norm) >= 6)
    )

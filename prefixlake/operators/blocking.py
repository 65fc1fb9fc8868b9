"""Lossless blocking for the text predicates.

Every predicate implies that both sides share at least one *signature*. Signatures are
exploded, joined on equality and the surviving pairs are checked with the exact predicate,
so no request ever meets the whole catalog. Both sides are distinct strings: copies of a
value, however many, cost one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.match import query_matches, template_match, token_fallback
from prefixlake.functions.text import deletions, grams, let, let_all, longest, squash, words
from prefixlake.session import hold

HOT_ROWS = 20_000
#: Queries whose rows are sent to all tasks at once.
QUERY_BLOCK = 5000
#: Blocks of queries beyond which both sides are shuffled by signature instead.
MOST_BLOCKS = 20


def _tag(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))


def _one(kind: str, value: Column, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.concat(F.lit(kind + ":"), value))).otherwise(
        F.array().cast("array<string>")
    )


def _spread(kind: str, tokens: Column) -> Column:
    return _tag(kind, F.flatten(F.transform(tokens, deletions)))


def _suffix_heads(tokens: Column) -> Column:
    """First three letters of the text squashed from each token on."""
    return let(
        tokens,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))),
            lambda s: F.left(F.array_join(F.slice(w, s, F.size(w)), ""), F.lit(3)),
        ),
    )


def value_signatures(h: Column) -> Column:
    """Signatures of a catalog value for :func:`query_matches`."""
    tokens = words(h)
    long_tokens = F.filter(tokens, lambda t: F.length(t) >= 3)
    return F.array_distinct(
        F.concat(
            _tag("t", grams(h)),
            _tag("p", F.transform(tokens, lambda t: F.left(t, F.lit(1)))),
            _tag("p", F.transform(tokens, lambda t: F.left(t, F.lit(2)))),
            _spread("d", long_tokens),
            _tag("c", _suffix_heads(tokens)),
            _one("r", F.left(h, F.lit(3)), F.length(h) >= 3),
        )
    )


def _query_form(n: Column) -> Column:
    tokens = words(n)
    anchor = longest(tokens)
    return F.concat(
        _one("t", F.left(anchor, F.lit(3)), F.length(anchor) >= 3),
        _one("p", anchor, F.length(anchor) < 3),
        _one("t", F.left(n, F.lit(3)), F.length(n) >= 3),
        F.when(F.length(anchor) >= 4, _tag("d", deletions(anchor))).otherwise(
            F.array().cast("array<string>")
        ),
        _one("c", F.left(squash(n), F.lit(3)), F.length(squash(n)) >= 3),
        _tag("r", grams(n)),
    )


def query_signatures(norm: Column, expanded: Column, tokens: Column) -> Column:
    """Signatures of a query for :func:`query_matches`, both text forms covered."""
    anchor = longest(F.filter(tokens, lambda t: F.length(t) >= 3))
    return F.array_distinct(
        F.concat(
            _query_form(norm),
            _query_form(expanded),
            _one("t", F.left(anchor, F.lit(3)), anchor.isNotNull()),
        )
    )


def trigger_signatures(t: Column) -> Column:
    """Signatures of a trigger phrase for :func:`template_match`."""
    tokens = words(t)
    anchor = longest(tokens)
    return F.array_distinct(
        F.concat(
            _tag("t", grams(t)),
            _tag("p", F.transform(tokens, lambda w: F.left(w, F.lit(1)))),
            _tag("p", F.transform(tokens, lambda w: F.left(w, F.lit(2)))),
            _tag("c", _suffix_heads(tokens)),
            _one("x", F.left(anchor, F.lit(3)), F.length(anchor) >= 3),
            _one("x", anchor, F.length(anchor) < 3),
            _one("x", F.left(t, F.lit(3)), F.length(t) >= 3),
            F.when(F.length(anchor) >= 4, _tag("e", deletions(anchor))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )


def firing_signatures(query: Column) -> Column:
    """Signatures of a query text that may fire a trigger phrase."""
    tokens = words(query)
    anchor = longest(tokens)
    unique = F.array_distinct(tokens)
    return F.array_distinct(
        F.concat(
            _one("t", F.left(anchor, F.lit(3)), F.length(anchor) >= 3),
            _one("p", anchor, F.length(anchor) < 3),
            _one("t", F.left(query, F.lit(3)), F.length(query) >= 3),
            _one("c", F.left(squash(query), F.lit(3)), F.length(squash(query)) >= 3),
            _one("c", F.left(F.get(unique, F.lit(0)), F.lit(3)), F.size(unique) == 1),
            _tag("x", grams(query)),
            _tag("x", F.transform(tokens, lambda w: F.left(w, F.lit(1)))),
            _tag("x", F.transform(tokens, lambda w: F.left(w, F.lit(2)))),
            _spread("e", F.filter(tokens, lambda w: F.length(w) >= 3)),
        )
    )


def _needles(tokens: Column) -> Column:
    """What a text must show that all tokens are near to: the longest token, and a half of the second longest.

    One edit leaves one of two halves as it is; a token of three letters has to be there whole.
    """
    ranked = F.array_sort(F.filter(tokens, lambda t: F.length(t) >= 3), lambda a, b: F.length(b) - F.length(a))
    second = F.coalesce(F.get(ranked, F.lit(1)), F.lit(""))
    cut = F.when(F.length(second) > 3, F.floor(F.length(second) / 2).cast("int")).otherwise(F.length(second))
    return let_all(
        lambda v: F.struct(
            v["longest"].alias("longest"), F.left(v["second"], v["cut"]).alias("head"),
            F.when(v["cut"] < F.length(v["second"]), F.substr(v["second"], v["cut"] + 1)).otherwise(v["second"]).alias("tail"),
        ),
        longest=longest(tokens), second=second, cut=cut,
    )


def _shows(text: Column, needles: Column, edited: bool = False) -> Column:
    """Plain substring tests that hold for every pair whose ``needles`` are near to ``text``.

    ``edited``: the longest token may differ by an edit.
    """
    second = F.contains(text, needles["head"]) | F.contains(text, needles["tail"])
    return second if edited else F.contains(text, needles["longest"]) & second


def _begins(text: Column, needles: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text), F.concat(F.lit(" "), needles["longest"]))


def _kind(kind: str) -> Column:
    return F.startswith(F.col("sig"), F.lit(kind + ":"))


def signature_join(left: DataFrame, right: DataFrame, hot_rows: int = HOT_ROWS, fits: Column | None = None) -> DataFrame:
    """Inner join of two tables on any shared element of their ``sigs`` arrays.

    The right side is the larger one; of its signatures only those that the left side asks for
    are joined. Spark takes an exploded array for one row, so the join is told to shuffle: by
    estimate the whole index would be broadcast. A signature held by more than ``hot_rows``
    right rows is split over as many salts as it needs, so no task takes a hot signature alone.
    Pairs that share several signatures come out several times. ``fits`` is a cheap test of a pair
    and its ``sig``, made where the pair arises.
    """
    left_cols = [c for c in left.columns if c != "sigs"]
    right_cols = [c for c in right.columns if c != "sigs"]
    asked = left.select(*left_cols, F.explode("sigs").alias("sig"))
    index = right.select(*right_cols, F.explode("sigs").alias("sig")).join(asked.select("sig").distinct(), "sig", "left_semi")
    hot = index.groupBy("sig").agg(
        F.ceil(F.count("*") / F.lit(float(hot_rows))).cast("int").alias("salts")
    ).filter("salts > 1")
    probes = (
        asked.join(hot, "sig", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("salts")
    )
    spread = (
        index.join(hot, "sig", "left")
        .withColumn(
            "salt",
            F.coalesce(F.pmod(F.xxhash64(*right_cols), F.col("salts")).cast("int"), F.lit(0)),
        )
        .drop("salts")
    )
    pairs = probes.join(spread.hint("merge"), ["sig", "salt"])
    return (pairs if fits is None else pairs.filter(fits)).drop("sig", "salt")


def meet_queries(queries: DataFrame, key: str, meet: Callable[[DataFrame], DataFrame], block: int = QUERY_BLOCK) -> DataFrame:
    """``meet(rows of a block)`` for blocks of about ``block`` queries each, as one table.

    For sides of which one is far larger: it is dealt by its own key, every task gets a block of
    queries, and what belongs to a pair is summed in the task it arises in.
    """
    queries = hold(queries)
    blocks = max(1, -(-queries.select(key).distinct().count() // block))
    met = None
    for b in range(blocks):
        part = meet(F.broadcast(queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else queries))
        met = part if met is None else met.unionByName(part)
    return met


def match_values(queries: DataFrame, values: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (norm, expanded, h) with the flags ``full`` and ``fallback``.

    ``full`` is the whole match test, ``fallback`` its token rule alone (which also holds for
    some short queries the whole test refuses). ``queries`` holds norm, expanded and tokens,
    ``values`` holds h; duplicates are removed before any pair is formed. A value stays in its
    task, which gets the signatures of a block of queries.
    """
    forms = queries.select("norm", "expanded", "tokens").filter("norm <> ''").dropDuplicates(["norm", "expanded"])
    h, norm, expanded, tokens = (F.col(c) for c in ("h", "norm", "expanded", "tokens"))
    left = hold(
        forms.select(
            "norm", "expanded", "tokens", query_signatures(norm, expanded, tokens).alias("sigs"), _needles(words(norm)).alias("n"),
            _needles(words(expanded)).alias("e"), _needles(F.filter(tokens, lambda t: F.length(t) >= 3)).alias("t"),
        )
    )
    right = values.select("h").filter("h <> ''").distinct()
    n, e, t = (F.col(c) for c in ("n", "e", "t"))
    # each kind of signature stands for rules that imply its test
    fits = (
        F.when(_kind("r"), F.contains(norm, h) | F.contains(expanded, h))
        .when(_kind("c"), F.contains(squash(h), squash(norm)) | F.contains(squash(h), squash(expanded)))
        .when(_kind("p"), _begins(h, n) | _begins(h, e))
        .when(_kind("d"), _shows(h, n, True) | _shows(h, e, True))
        .otherwise(_shows(h, n) | _shows(h, e) | _shows(h, t))
    )
    tested = lambda pairs: pairs.select(
        "norm", "expanded", "h",
        query_matches(h, norm, expanded, tokens).alias("full"),
        token_fallback(h, tokens).alias("fallback"),
    ).filter("full or fallback")
    if left.count() > MOST_BLOCKS * QUERY_BLOCK:
        signed = hold(right).withColumn("sigs", value_signatures(h))
        # the tokens follow from the two forms: without their array, equal pairs meet in hash tables
        pairs = signature_join(left.drop("tokens"), signed, hot_rows, fits).select("norm", "expanded", "h").distinct()
        return tested(pairs.join(left.select("norm", "expanded", "tokens"), ["norm", "expanded"]))

    def meet(part: DataFrame) -> DataFrame:
        signed = right.select("h", F.explode(value_signatures(h)).alias("sig"))
        pairs = signed.join(part.select("form", "norm", "expanded", "n", "e", "t", F.explode("sigs").alias("sig")).hint("broadcast"), "sig")
        met = pairs.filter(fits).select("h", "form").distinct()
        return tested(met.join(part.select("form", "norm", "expanded", "tokens").hint("broadcast"), "form"))

    return meet_queries(left.withColumn("form", F.monotonically_increasing_id()), "form", meet)


def stem_signatures(tokens: Column) -> Column:
    """Equality or four-letter-stem keys of tokens, for the stem-sharing predicates."""
    return F.array_distinct(
        F.concat(
            _tag("w", F.filter(tokens, lambda t: F.length(t) < 4)),
            _tag("f", F.transform(F.filter(tokens, lambda t: F.length(t) >= 4), lambda t: F.left(t, F.lit(4)))),
        )
    )


def fire_triggers(queries: DataFrame, triggers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (query, trigger) for which the trigger phrase fires."""
    left = queries.select("query").filter("query <> ''").distinct()
    query, trigger, asks, needs = (F.col(c) for c in ("query", "trigger", "asks", "needs"))
    left = hold(left.select("query", firing_signatures(query).alias("sigs"), _needles(words(query)).alias("asks")))
    right = hold(triggers.select("trigger").filter("trigger <> ''").distinct())
    right = right.select("trigger", trigger_signatures(trigger).alias("sigs"), _needles(words(trigger)).alias("needs"))
    lone = F.substring_index(query, " ", 1)
    # each kind of signature stands for rules that imply its test
    fits = (
        F.when(_kind("c"), F.contains(squash(trigger), squash(query)) | F.contains(squash(trigger), lone))
        .when(_kind("p"), _begins(trigger, asks))
        .when(_kind("x"), _shows(query, needs))
        .when(_kind("e"), _shows(query, needs, True))
        .otherwise(_shows(trigger, asks))
    )
    pairs = signature_join(left, right, hot_rows, fits).select("query", "trigger").distinct()
    return pairs.filter(template_match(F.col("query"), F.col("trigger")))


"""Query understanding: expansion, compact-word segmentation, rewrite proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefixlake.functions.text import (
    contains_token_phrase,
    dot_words,
    is_coordinate_like,
    normalize_text,
    plain,
    quoted,
    replace_token_phrase,
    words,
)
from prefixlake.operators.lexicon import Lexicon
from prefixlake.rules import QUERY_ALIASES
from prefixlake.session import hold

RULE = "struct<ord:struct<part:int,len:int,row_ord:bigint,src:string,dst:string>,src:string,dst:string,label:string>"


def fixed_rules() -> Column:
    """The fixed aliases as an array of rules, in their order."""
    rows = ", ".join(
        f"named_struct('ord', named_struct('part', 0, 'len', {i}, 'row_ord', 0L, 'src', '', 'dst', ''), "
        f"'src', {quoted(plain(a))}, 'dst', {quoted(plain(t))}, 'label', {quoted(f'{a} -> {t}')})"
        for i, (a, t) in enumerate(QUERY_ALIASES)
    )
    return F.expr(f"array({rows})").cast(f"array<{RULE}>")


def rewrite_rules(abbreviations: DataFrame) -> DataFrame:
    """Abbreviations as rules (first word of the source, rule); applied longest source first, then in file order."""
    src, dst = normalize_text(F.col("abbreviation")), normalize_text(F.col("expanded_form"))
    rows = abbreviations.select(src.alias("src"), dst.alias("dst"), F.concat_ws(" -> ", "abbreviation", "expanded_form").alias("label"), F.col("row_ord").cast("bigint").alias("row_ord"))
    order = F.struct(F.lit(1).alias("part"), (-F.length("src")).alias("len"), "row_ord", "src", "dst")
    return rows.filter("src <> ''").select(
        F.element_at(words(F.col("src")), 1).alias("first"), F.struct(order.alias("ord"), "src", "dst", "label").cast(RULE).alias("rule")
    ).distinct()


def fold_rules(norm: Column, rules: Column) -> Column:
    """Apply ordered rules; each rewrite feeds the next one. ``seen`` holds the text after every rewrite."""
    start = F.struct(norm.alias("text"), F.array().cast("array<string>").alias("applied"), F.array(norm).alias("seen"))
    step = lambda acc, r: F.when(
        contains_token_phrase(acc["text"], r["src"]),
        F.struct(
            replace_token_phrase(acc["text"], r["src"], r["dst"]).alias("text"),
            F.concat(acc["applied"], F.array(r["label"])).alias("applied"),
            F.concat(acc["seen"], F.array(replace_token_phrase(acc["text"], r["src"], r["dst"]))).alias("seen"),
        ),
    ).otherwise(acc)
    return F.aggregate(rules, start, step)


def expand_texts(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """norm -> x (text, applied) for distinct normalized texts.

    A text meets only the rules whose source it, or a text it has become, contains: they are
    found by a join on the source's first word. Folding them can bring up further rules, so the
    join is repeated for the texts that changed until it finds no new rule.
    """
    none = F.array().cast(f"array<{RULE}>")
    todo = texts.select("norm").distinct().select("norm", F.array("norm").alias("seen"), none.alias("own"))
    done = None
    while True:
        probes = todo.select("norm", F.explode("seen").alias("now")).select("norm", "now", F.explode(F.array_distinct(words(F.col("now")))).alias("first"))
        hits = probes.join(rules, "first").filter(contains_token_phrase(F.col("now"), F.col("rule.src")))
        found = hits.groupBy("norm").agg(F.collect_set("rule").alias("hit"))
        both = F.array_union("own", F.coalesce("hit", none))
        folded = hold(
            todo.join(found, "norm", "left").select("norm", (F.size(both) > F.size("own")).alias("grew"), both.alias("own"))
            .withColumn("x", fold_rules(F.col("norm"), F.concat(fixed_rules(), F.array_sort("own"))))
        )
        # a text that no rule changed, or that met no new rule, is final
        more = F.col("grew") if done is not None else F.size("x.applied") > 0
        settled = folded.filter(~more).select("norm", F.struct("x.text", "x.applied").alias("x"))
        done = settled if done is None else done.unionByName(settled)
        todo = folded.filter(more).select("norm", F.col("x.seen").alias("seen"), "own")
        if todo.isEmpty():
            return done


def expand_queries(requests: DataFrame, abbreviations: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Distinct queries with norm, expanded, expansions and tokens."""
    rules = rewrite_rules(abbreviations) if rules is None else rules
    # held, or the null test of the join's key normalizes every request before they become distinct
    asked = hold(requests.select("q").distinct()).withColumn("norm", normalize_text(F.col("q")))
    return asked.join(expand_texts(asked, rules), "norm").select(
        "q", "norm", F.col("x.text").alias("expanded"), F.col("x.applied").alias("expansions"), dot_words(F.col("x.text")).alias("tokens")
    )


# --- keyboard-code repair ---------------------------------------------------------------


def telex_plain(token: Column) -> Column:
    """The token with doubled-letter and w keyboard codes resolved."""
    out = token
    # fixed values: keyboard code -> letter, in this order
    for code, letter in [("dd", "d"), ("aa", "a"), ("aw", "a"), ("ee", "e"), ("oo", "o"), ("ow", "o"), ("uw", "u")]:
        out = F.replace(out, F.lit(code), F.lit(letter))
    return F.regexp_replace(out, "([aeiouy])w", "$1")


def telex_toneless(token: Column) -> Column:
    """The token without a closing tone key."""
    return F.regexp_replace(token, "([aeiouy][a-z]*?)[sfrxj]$", "$1")


def telex_candidates(token: Column) -> Column:
    """Repairs to test against the lexicon, best first; none for short tokens."""
    options = F.array(telex_plain(token), telex_toneless(token))
    return F.when(
        F.length(token) >= 3, F.filter(F.array_distinct(options), lambda c: c != token)
    ).otherwise(F.array().cast("array<string>"))


def repair_telex(tokens: DataFrame, lexicon: Lexicon) -> DataFrame:
    """token -> decoded: the first candidate the lexicon knows, else the token itself."""
    known = lexicon.tokens.select(F.col("token").alias("candidate"))
    found = (
        tokens.select("token", F.posexplode(telex_candidates(F.col("token"))).alias("rank", "candidate"))
        .join(known, "candidate")
        .groupBy("token").agg(F.min_by("candidate", "rank").alias("decoded"))
    )
    return tokens.join(found, "token", "left").select("token", F.coalesce("decoded", "token").alias("decoded"))


# --- compact-word segmentation ----------------------------------------------------------


def _pieces(tokens: DataFrame) -> DataFrame:
    """All substrings of up to twelve letters, with their span."""
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.length("token") - 1),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(12), F.length("token") - s)),
                lambda n: F.struct(
                    s.alias("s"), (s + n).alias("e"), F.substr(F.col("token"), s + 1, n).alias("piece")
                ),
            ),
        )
    )
    return tokens.select("token", F.explode(spans).alias("span")).select("token", "span.*")


def _resolve_pieces(pieces: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Which distinct substrings are words, repairable words or word beginnings."""
    distinct = pieces.select("piece").distinct()
    candidates = telex_candidates(F.col("piece"))
    asks = F.concat(
        F.array(
            F.struct(F.lit("token").alias("kind"), F.col("piece").alias("key"), F.lit(0).alias("role")),
            F.struct(F.lit("root").alias("kind"), F.col("piece").alias("key"), F.lit(9).alias("role")),
        ),
        F.transform(
            candidates,
            lambda c, i: F.struct(F.lit("token").alias("kind"), c.alias("key"), (i + 1).alias("role")),
        ),
    )
    known = lexicon.dictionary.filter("kind in ('token', 'root')").select("kind", "key")
    best = F.min(F.when(F.col("role") < 9, F.struct("role", "key")))
    return (
        distinct.select("piece", F.explode(asks).alias("ask")).select("piece", "ask.*")
        .join(known, ["kind", "key"])
        .groupBy("piece")
        .agg(best.alias("word"), F.max((F.col("role") == 9).cast("int")).alias("is_root"))
    )


def token_score(token: Column) -> Column:
    return F.when(F.length(token) >= 4, 4.0).when(F.length(token) == 3, 2.0).otherwise(1.0)


def _best_path(edges: Column, size: Column, anchors: Column) -> Column:
    """Best-scoring split over an edge list sorted by (end, start); first one wins ties."""
    empty = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("parts"))
    none = F.lit(None).cast("struct<score:double,parts:array<string>>")
    start = F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i == 0, empty).otherwise(none))

    def step(table: Column, edge: Column) -> Column:
        before = F.get(table, edge["s"])
        now = F.get(table, edge["e"])
        allowed = ~edge["lone"] | F.exists(before["parts"], lambda p: F.array_contains(anchors, p))
        score = before["score"] + edge["gain"]
        better = before.isNotNull() & allowed & (now.isNull() | (score > now["score"]))
        made = F.struct(score.alias("score"), F.concat(before["parts"], F.array(edge["word"])).alias("parts"))
        return F.when(
            F.coalesce(better, F.lit(False)),
            F.transform(table, lambda x, i: F.when(i == edge["e"], made).otherwise(x)),
        ).otherwise(table)

    return F.element_at(F.aggregate(edges, start, step), -1)


def prefix_anchors(abbreviations: DataFrame) -> DataFrame:
    """One-word abbreviations and aliases (word), after which a one-letter ending is accepted."""
    fixed = F.explode(F.array(*[F.lit(plain(a)) for a, _ in QUERY_ALIASES if " " not in plain(a)]))
    short = abbreviations.select(normalize_text(F.col("abbreviation")).alias("word")).filter("word <> '' and not contains(word, ' ')")
    return short.sparkSession.range(1).select(fixed.alias("word")).union(short).distinct()


def segment_tokens(tokens: DataFrame, lexicon: Lexicon, abbreviations: DataFrame) -> DataFrame:
    """token -> segmented (null when it stays whole), for distinct tokens.

    A token that is the beginning of a squashed phrase becomes that phrase (shortest one);
    otherwise it is split into lexicon words if two or more cover it.
    """
    asked = tokens.select("token").distinct().filter("length(token) >= 3")
    joined = lexicon.dictionary.filter("kind = 'joined'").select(F.col("key").alias("token"), "value")
    looked_up = hold(asked.join(joined, "token", "left"))
    rest = looked_up.filter("value is null").select("token")
    pieces = _pieces(rest)
    digits = F.col("piece").rlike("^[0-9]+$")
    last = F.col("e") == F.length("token")
    word = F.when(F.col("word.role") == 0, F.col("piece")).when(digits, F.col("piece")).otherwise(F.col("word.key"))
    ending = F.col("word").isNull() & ~digits & (F.col("is_root") == 1) & last & (F.col("s") > 0)
    adjust = (
        F.when((F.col("word.role") == 0) | digits, F.when(F.col("piece").rlike("^[0-9]$"), -0.5).otherwise(0.0))
        .when(F.col("word").isNotNull(), -0.25)
        .otherwise(-0.5)
    )
    edges = (
        pieces.join(_resolve_pieces(pieces, lexicon), "piece", "left")
        .filter(digits | F.col("word").isNotNull() | ending)
        .select(
            "token", "e", "s",
            F.coalesce(word, F.col("piece")).alias("word"),
            (token_score(F.coalesce(word, F.col("piece"))) + adjust).alias("gain"),
            F.coalesce(ending & (F.length("piece") == 1), F.lit(False)).alias("lone"),
        )
        .join(prefix_anchors(abbreviations).withColumn("anchor", F.lit(True)), "word", "left")
        .groupBy("token")
        .agg(
            F.array_sort(F.collect_list(F.struct("e", "s", "word", "gain", "lone"))).alias("edges"),
            F.collect_set(F.when(F.col("anchor"), F.col("word"))).alias("anchors"),
        )
    )
    split = edges.withColumn(
        "best", _best_path(F.col("edges"), F.length("token"), F.col("anchors"))
    ).select("token", F.when(F.size("best.parts") >= 2, F.array_join("best.parts", " ")).alias("split"))
    return looked_up.join(split, "token", "left").select(
        "token", F.coalesce("value", "split").alias("segmented")
    )


# --- query-level decision ---------------------------------------------------------------


def _cover_count(tokens: Column, hits: Column) -> Column:
    """Largest number of known phrases that tile the tokens, -1 when none does."""
    start = F.array(F.lit(0))

    def best_at(table: Column, end: Column) -> Column:
        scores = F.transform(
            F.sequence(F.lit(0), F.greatest(end - 2, F.lit(0))),
            lambda s: F.when(
                (F.get(table, s) >= 0)
                & F.array_contains(hits, F.concat(F.lit("phrase:"), F.array_join(F.slice(tokens, s + 1, end - s), " "))),
                F.get(table, s) + 1,
            ).otherwise(F.lit(-1)),
        )
        return F.when(end >= 2, F.array_max(scores)).otherwise(F.lit(-1))

    table = F.aggregate(
        F.sequence(F.lit(1), F.size(tokens)), start, lambda t, e: F.concat(t, F.array(best_at(t, e)))
    )
    return F.element_at(table, -1)


def accept_segmentation(variants: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Decide whether a token-wise segmentation of a multi-word query stands.

    ``variants`` holds (text, segmented, changed); out comes ``accepted`` (null = rejected).
    """
    seg = words(F.col("segmented"))
    tail = F.element_at(seg, -1)
    head = F.array_join(F.slice(seg, F.lit(1), F.size(seg) - 1), " ")
    head_kind = F.when(F.contains(head, F.lit(" ")), F.lit("phrase")).otherwise(F.lit("token"))
    ask = lambda kind, key: F.struct(kind.alias("kind"), key.alias("key"))
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("seg")),
            lambda s: F.transform(
                F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("seg") - s + 1)),
                lambda n: ask(F.lit("phrase"), F.array_join(F.slice("seg", s, n), " ")),
            ),
        )
    )
    base = variants.select("text", "segmented", "changed").distinct().select(
        "*", seg.alias("seg"), tail.alias("tail"), head.alias("head"), head_kind.alias("head_kind")
    )
    asks = F.concat(
        F.array(
            ask(F.col("head_kind"), F.col("head")), ask(F.lit("lead"), F.col("segmented")),
            ask(F.lit("stem"), F.col("tail")),
        ),
        F.when(F.col("changed"), grams).otherwise(F.array().cast("array<struct<kind:string,key:string>>")),
    )
    hits = (
        base.select("text", F.explode(F.array_distinct(asks)).alias("ask")).select("text", "ask.*")
        .join(lexicon.dictionary.select("kind", "key"), ["kind", "key"], "left_semi")
        .groupBy("text").agg(F.collect_set(F.concat_ws(":", "kind", "key")).alias("hits"))
    )
    has = lambda kind, key: F.array_contains("hits", F.concat(kind, F.lit(":"), key))
    known_head = (F.col("head") != "") & has(F.col("head_kind"), F.col("head"))
    completes = known_head & (F.col("tail") == "gan")
    stands = (
        has(F.lit("lead"), F.col("segmented"))
        | (_cover_count(F.col("seg"), F.col("hits")) >= 2)
        | (known_head & (F.length("tail") >= 3) & has(F.lit("stem"), F.col("tail")))
    )
    accepted = (
        F.when(completes, F.concat(F.col("head"), F.lit(" gan day")))
        .when(F.col("changed") & stands, F.col("segmented"))
    )
    return base.join(hits, "text", "left").withColumn(
        "hits", F.coalesce("hits", F.array().cast("array<string>"))
    ).select("text", accepted.alias("accepted"))


def complete_proximity(queries: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Queries ending in the bare proximity word after a known phrase: (text, completed)."""
    asked = queries.select(F.col("norm").alias("text")).distinct().filter("endswith(text, ' gan')")
    head = F.left("text", F.length("text") - 4)
    kind = F.when(F.contains(head, F.lit(" ")), F.lit("phrase")).otherwise(F.lit("token"))
    return (
        asked.select("text", kind.alias("kind"), head.alias("key"))
        .join(lexicon.dictionary.select("kind", "key"), ["kind", "key"], "left_semi")
        .select("text", F.concat("key", F.lit(" gan day")).alias("completed"))
    )


def propose_rewrites(
    queries: DataFrame, lexicon: Lexicon, abbreviations: DataFrame, k: int = 3
) -> DataFrame:
    """Up to ``k`` rewrites per normalized query: norm, rank, rewrite, confidence, reason, source."""
    asked = queries.select("norm").distinct().filter((F.col("norm") != "") & ~is_coordinate_like(F.col("norm")))
    spelled = asked.select("norm", F.posexplode(words(F.col("norm"))).alias("pos", "token"))
    tokens = spelled.select("token").distinct()
    decoded = hold(repair_telex(tokens, lexicon))
    forms = decoded.select(F.explode(F.array_distinct(F.array("token", "decoded"))).alias("token")).distinct()
    segments = hold(segment_tokens(forms, lexicon, abbreviations))
    word_map = (
        decoded.join(segments.select("token", F.col("segmented").alias("seg_raw")), "token", "left")
        .join(segments.select(F.col("token").alias("decoded"), F.col("segmented").alias("seg_dec")), "decoded", "left")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token", "decoded", "seg_raw", "seg_dec")))
    rows = spelled.join(word_map, "token").groupBy("norm").agg(ordered.alias("w"))

    def variant(plain_field: str, seg_field: str) -> Column:
        pick = lambda x: F.coalesce(x[seg_field], x[plain_field])
        moved = lambda x: x[seg_field].isNotNull() & (x[seg_field] != x[plain_field])
        return F.struct(
            F.array_join(F.transform("w", lambda x: x[plain_field]), " ").alias("text"),
            F.array_join(F.transform("w", pick), " ").alias("segmented"),
            F.exists("w", moved).alias("changed"),
        )

    forms2 = rows.select(
        "norm", variant("token", "seg_raw").alias("raw"), variant("decoded", "seg_dec").alias("dec")
    )
    variants = forms2.select(
        "norm", F.posexplode(F.array_distinct(F.array("raw", "dec"))).alias("slot", "v")
    ).select("norm", "slot", "v.*")
    variants = hold(variants)
    decided = accept_segmentation(variants.filter("contains(text, ' ')"), lexicon)
    settled = variants.join(decided, "text", "left").withColumn(
        "final",
        F.when(F.contains("text", F.lit(" ")), F.col("accepted")).when(F.col("changed"), F.col("segmented")),
    )
    by_slot = lambda n, c: F.max(F.when(F.col("slot") == n, F.col(c)))
    per_query = settled.groupBy("norm").agg(
        by_slot(0, "final").alias("f0"), by_slot(1, "final").alias("f1"), by_slot(1, "text").alias("t1")
    )
    telex = F.coalesce("t1", "norm")
    entry = lambda rewrite, conf, reason, source, ord_: F.struct(
        (-conf).alias("neg"), F.lit(ord_).alias("ord"), rewrite.alias("rewrite"), conf.alias("confidence"),
        reason.alias("reason"), source.alias("source"),
    )

    def segmented_entry(final: Column, text: Column, ord_: int) -> Column:
        completion = text.rlike("(^| )gan$") & final.rlike("(^| )gan day$")
        return entry(
            final,
            F.when(completion, 0.86).otherwise(0.9),
            F.concat(
                F.when(completion, F.lit("Vietnamese contextual prefix completion: ")).otherwise(
                    F.lit("Vietnamese compact syllable segmentation: ")
                ),
                text, F.lit(" -> "), final,
            ),
            F.when(completion, F.lit("contextual-completion")).otherwise(F.lit("syllable-segmentation")),
            ord_,
        )

    telex_entry = entry(
        telex, F.lit(0.82), F.concat(F.lit("Telex/VNI-style cleanup: "), "norm", F.lit(" -> "), telex),
        F.lit("telex-vni-decoder"), 0,
    )
    f0_ok = F.col("f0").isNotNull() & (F.col("f0") != F.col("norm")) & (F.col("t1").isNull() | (F.col("f0") != telex))
    f1_ok = (
        F.col("f1").isNotNull() & (F.col("f1") != F.col("norm")) & (F.col("f1") != telex)
        & (F.col("f0").isNull() | (F.col("f1") != F.col("f0")))
    )
    options = F.array_compact(
        F.array(
            F.when(telex != F.col("norm"), telex_entry),
            F.when(f0_ok, segmented_entry(F.col("f0"), F.col("norm"), 1)),
            F.when(f1_ok, segmented_entry(F.col("f1"), telex, 2)),
        )
    )
    return (
        per_query.select("norm", F.posexplode(F.slice(F.array_sort(options), 1, k)).alias("rank", "o"))
        .select("norm", "rank", "o.rewrite", "o.confidence", "o.reason", "o.source")
    )


def understand(requests: DataFrame, lexicon: Lexicon, abbreviations: DataFrame) -> DataFrame:
    """Distinct queries with the best rewrite applied: q, norm, expanded, expansions, tokens."""
    rules = rewrite_rules(abbreviations)
    return understand_from(hold(expand_queries(requests, abbreviations, rules)), lexicon, abbreviations, rules)


def understand_from(base: DataFrame, lexicon: Lexicon, abbreviations: DataFrame, rules: DataFrame) -> DataFrame:
    """As :func:`understand`, for queries that are expanded already."""
    proposed = hold(propose_rewrites(base, lexicon, abbreviations, k=1).withColumn("written", normalize_text(F.col("rewrite"))))
    again = expand_texts(proposed.select(F.col("written").alias("norm")), rules).select(F.col("norm").alias("written"), F.col("x").alias("again"))
    best = proposed.join(again, "written").select("norm", "again", F.concat_ws(": ", "source", "reason").alias("note"))
    expanded = F.coalesce("again.text", "expanded")
    notes = F.concat("expansions", F.array("note"), "again.applied")
    return base.join(best, "norm", "left").select(
        "q", "norm", expanded.alias("expanded"),
        F.when(F.col("note").isNotNull(), notes).otherwise(F.col("expansions")).alias("expansions"),
        dot_words(expanded).alias("tokens"),
    )

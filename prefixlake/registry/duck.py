"""Check SQL building blocks: every expression is written a second time, in plain SQL."""

from __future__ import annotations

from prefixlake.functions.text import plain
from prefixlake.rules import CITY_ALIASES, QUERY_ALIASES, SEMANTIC_EXPANSIONS
from prefixlake.sources.tables import DEPENDS, INPUT_SQL, NATION_ABBREVIATIONS, STAR


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def unaccent(x: str) -> str:
    return f"replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D')"


def norm(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower({unaccent(x)}), '[-_/]+', ' ', 'g'), "
        f"'[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'))"
    )


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def dot_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[ .]+'), lambda t: t <> '')"


def flat(x: str) -> str:
    return f"replace({x}, ' ', '')"


def has_phrase(x: str, p: str) -> str:
    return f"contains(' ' || {x} || ' ', ' ' || {p} || ' ')"


def has_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def round3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5) / 1000)"


def clamp01(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


def prefix_phrase(h: str, q: str) -> str:
    """As a pattern: each query word starts a word, in a row."""
    pattern = f"' ' || replace(replace({q}, '.', '[.]'), ' ', '[^ ]* ')"
    return f"({q} <> '' AND regexp_matches(' ' || {h}, {pattern}))"


def compact_cross(h: str, cq: str) -> str:
    w = words(h)
    return (
        f"(length({cq}) >= 3 AND contains({flat(h)}, {cq}) AND len(list_filter(range(1, len({w})), lambda s: length({cq}) > length(({w})[s]) "
        f"AND starts_with(array_to_string(({w})[s:], ''), {cq}))) > 0)"
    )


def all_of(items: str, cond: str, var: str = "t") -> str:
    return f"(len(list_filter({items}, lambda {var}: NOT coalesce({cond}, false))) = 0)"


def any_of(items: str, cond: str, var: str = "t") -> str:
    return f"(len(list_filter({items}, lambda {var}: {cond})) > 0)"


def starts_some_word(h: str, t: str) -> str:
    return f"contains(' ' || {h}, ' ' || {t})"


def long_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: length(t) >= 3)"


def fuzzy(h: str, n: str) -> str:
    near = (
        f"CASE WHEN length(t) <= 3 THEN {starts_some_word(h, 't')} ELSE contains({h}, t) OR "
        + any_of(words(h).replace("lambda t: t", "lambda y: y"), "left(w, 1) = left(t, 1) AND levenshtein(w, t) <= 1", "w") + " END"
    )
    return (
        f"({n} = '' OR {h} = {n} OR (length({n}) >= 3 AND contains({h}, {n})) OR (length({h}) >= 3 AND contains({n}, {h})) "
        f"OR (len({long_words(n)}) > 0 AND {all_of(long_words(n), near)}))"
    )


def evidence(h: str, t: str) -> str:
    return f"CASE WHEN length({t}) < 3 THEN false WHEN length({t}) = 3 THEN {starts_some_word(h, t)} ELSE contains({h}, {t}) END"


def fallback(h: str, tokens: str) -> str:
    long_tokens = f"list_filter({tokens}, lambda t: length(t) >= 3)"
    return f"(len({long_tokens}) > 0 AND {all_of(long_tokens, evidence(h, 't'))})"


def query_matches(h: str, n: str, e: str, tokens: str) -> str:
    def form(q):
        return f"{fuzzy(h, q)} OR {prefix_phrase(h, q)} OR {compact_cross(h, flat(q))}"

    w = words(n)
    short_tail = f"len({w}) > 1 AND length(({w})[-1]) < 3 AND {n} = {e}"
    return (
        f"CASE WHEN {h} = '' THEN false WHEN {short_tail} THEN {prefix_phrase(h, n)} "
        f"ELSE {form(n)} OR ({n} <> {e} AND ({form(e)})) OR {fallback(h, tokens)} END"
    )


def significant_every(q: str, h: str) -> str:
    w, lw = words(q), long_words(q)
    return f"((len({w}) <= 1 OR len({lw}) >= 2) AND len({lw}) > 0 AND {all_of(lw, evidence(h, 't'))})"


def template_match(q: str, trig: str) -> str:
    qw, tw = words(q), words(trig)
    uniq = f"list_distinct({qw})"
    joined = f"{compact_cross(trig, flat(q))} OR (len({uniq}) = 1 AND {compact_cross(trig, f'({qw})[1]')})"
    short = any_of(tw, "length(t) <= 2")
    loose = (
        f"{prefix_phrase(trig, q)} OR {prefix_phrase(q, trig)} OR (NOT {short} AND {fuzzy(q, trig)}) OR {significant_every(q, trig)}"
    )
    return f"(({joined}) OR (NOT (len({qw}) < 2 AND len({tw}) > 1) AND ({loose})))"


def stem(a: str, b: str) -> str:
    return f"({a} = {b} OR (least(length({a}), length({b})) >= 4 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))))"


def category_evidence(ev: str, cat: str) -> str:
    inner = any_of(words(ev).replace("lambda t: t", "lambda y: y"), stem("w", "t"), "w")
    return all_of(words(cat), inner)


def phrase_evidence(q: str, p: str) -> str:
    raw = words(p)
    parts = f"CASE WHEN len({raw}) > 1 THEN list_filter({raw}, lambda t: length(t) >= 2) ELSE {raw} END"
    q_words = words(q).replace("lambda t: t", "lambda y: y")
    one = any_of(q_words, "CASE WHEN length(t) < 3 THEN w = t ELSE starts_with(w, t) OR (length(w) >= 3 AND starts_with(t, w)) END", "w")
    lone = f"(len({raw}) = 1 AND length({p}) < 3)"
    return f"({p} <> '' AND ({has_phrase(q, p)} OR (len({parts}) > 0 AND NOT {lone} AND {all_of(f'({parts})', one)})))"


def grams(x: str, n: int = 3) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n})))"


def dice(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
    )


def expand_semantic(x: str) -> str:
    parts = [f"[{x}]"]
    for term, extra in SEMANTIC_EXPANSIONS.items():
        parts.append(f"CASE WHEN {has_phrase(x, lit(term))} THEN [{lits(extra)}] ELSE []::VARCHAR[] END")
    joined = parts[0]
    for part in parts[1:]:
        joined = f"list_concat({joined}, {part})"
    # first occurrence order, as text: keep an item when it does not occur before
    return (
        f"(SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i "
        f"FROM (SELECT {joined} AS l)) WHERE v <> '' GROUP BY v))"
    )


def sem_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: length(t) >= 2))"


def overlap(qt: str, dt: str) -> str:
    big = f"list_filter({qt}, lambda t: length(t) >= 3)"
    weight = "CASE WHEN length(t) >= 5 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END"
    hit = any_of(dt, stem("t", "w"), "w")
    total = f"list_sum(list_transform({big}, lambda t: {weight}))"
    hits = f"coalesce(list_sum(list_transform(list_filter({big}, lambda t: {hit}), lambda t: {weight})), 0)"
    return f"CASE WHEN len({big}) > 0 AND len({dt}) > 0 THEN {hits} / {total} ELSE 0.0::DOUBLE END"


def strong(qt: str, dt: str) -> str:
    big = f"list_filter({qt}, lambda t: length(t) >= 3)"
    hits = f"list_filter({big}, lambda t: {any_of(dt, stem('t', 'w'), 'w')})"
    return f"(len({hits}) >= least(2, len({big})))"


def city_key(x: str) -> str:
    arms = " ".join(f"WHEN {x} IN ({lits(al)}) THEN {lit(k)}" for k, al in CITY_ALIASES.items())
    return f"CASE {arms} ELSE {x} END"


def haversine(a: str, b: str, c: str, d: str) -> str:
    s1, s2 = f"sin(radians({c} - {a}) / 2)", f"sin(radians({d} - {b}) / 2)"
    inner = f"({s1} * {s1} + cos(radians({a})) * cos(radians({c})) * {s2} * {s2})"
    return f"(6371000.0::DOUBLE * 2 * atan2(sqrt({inner}), sqrt(1 - {inner})))"


def category_intent(x: str) -> str:
    return (
        f"CASE WHEN {has_any(x, ['atm', 'benh vien', 'cay xang', 'tram xang'])} THEN 'Nearby Search' "
        f"WHEN {has_any(x, ['san bay', 'ben xe', 'dai hoc'])} THEN 'POI Search' ELSE 'Category Search' END"
    )


# --- inputs -----------------------------------------------------------------------------


def _input(name: str) -> str:
    text = INPUT_SQL[name]
    for dep in DEPENDS[name]:
        text = text.replace("{" + dep + "}", dep if dep in STAR else f"in_{dep}")
    text = text.replace("VARCHAR(20)", "VARCHAR").replace("VARCHAR(9)", "VARCHAR")
    if name == "pois":
        text = f"SELECT *, list_filter(string_split(tags_text, ';'), lambda t: t <> '') AS tags FROM ({text})"
    return text


def inputs(*names: str) -> list[str]:
    """CTEs ``in_<name>`` for the derived inputs, with what they depend on."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in DEPENDS[name]:
            if dep not in STAR and dep not in order:
                need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return [f"in_{n} AS MATERIALIZED ({_input(n)})" for n in order]


def with_(ctes: list[str], body: str) -> str:
    """A statement over CTEs; inputs asked for twice are kept once."""
    kept = list(dict.fromkeys(ctes))
    return "WITH " + ",\n".join(kept) + "\n" + body


def widen(x: str) -> str:
    return f"' ' || replace({x}, ' ', '  ') || ' '"


def expansion_rules() -> list[tuple[str, str, str]]:
    """(source, target, label) in the order of application."""
    rules = [(plain(a), plain(t), f"{a} -> {t}") for a, t in QUERY_ALIASES]
    short = [(a, e, i) for i, (a, e, _) in enumerate(NATION_ABBREVIATIONS)]
    short += [(f"n{i}", f"NATION_{i}", i) for i in range(len(NATION_ABBREVIATIONS), 25)]
    short.sort(key=lambda r: (-len(plain(r[0])), r[2]))
    return rules + [(plain(a), plain(e), f"{a} -> {e}") for a, e, _ in short]


def expansion_ctes(source: str, out: str = "forms") -> list[str]:
    """CTEs that rewrite ``source``(q, norm) rule by rule into ``out``(q, norm, expanded, expansions, tokens)."""
    ctes = [f"x0 AS (SELECT q, norm, norm AS e, []::VARCHAR[] AS applied FROM {source})"]
    rules = expansion_rules()
    for i, (src, dst, label) in enumerate(rules):
        hit = has_phrase("e", lit(src))
        swapped = f"trim(regexp_replace(replace({widen('e')}, {widen(lit(src))}, {widen(lit(dst))}), ' +', ' ', 'g'))"
        ctes.append(
            f"x{i + 1} AS (SELECT q, norm, CASE WHEN {hit} THEN {swapped} ELSE e END AS e, "
            f"CASE WHEN {hit} THEN list_append(applied, {lit(label)}) ELSE applied END AS applied FROM x{i})"
        )
    ctes.append(
        f"{out} AS MATERIALIZED (SELECT q, norm, e AS expanded, applied AS expansions, {dot_words('e')} AS tokens FROM x{len(rules)})"
    )
    return ctes


def form_ctes() -> list[str]:
    return inputs("requests") + [
        f"qs AS MATERIALIZED (SELECT q, {norm('q')} AS norm FROM (SELECT DISTINCT q FROM in_requests))"
    ] + expansion_ctes("qs")

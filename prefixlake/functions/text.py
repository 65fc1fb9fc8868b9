"""Text column expressions, built from native Spark functions only.

Functions whose argument is called ``norm`` expect text that already went through
:func:`normalize_text`; normalizing once per value keeps the regex work off the joins.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

COMBINING = "[\\u0300-\\u036f]"


def let(value: Column, body) -> Column:
    """Bind an expression once and use it in ``body``.

    A lambda re-evaluates the outer expressions it mentions for every element; a bound
    variable is evaluated a single time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(body, **values: Column) -> Column:
    """As :func:`let` for several values, handed over as one struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Every letter that decomposes to one base letter plus marks, with that base."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        if not char.isalpha():
            continue
        parts = unicodedata.normalize("NFD", char)
        base = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if len(parts) > 1 and len(base) == 1:
            source.append(char)
            target.append(base)
    source += ["đ", "Đ"]
    target += ["d", "D"]
    return "".join(source), "".join(target)


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lit_array(values) -> Column:
    """A constant string array, built in one step."""
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def lit_map(table: dict[str, str]) -> Column:
    """A constant string map, built in one step."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")


def strip_accents(c: Column) -> Column:
    source, target = accent_table()
    return F.regexp_replace(F.translate(c, source, target), COMBINING, "")


def normalize_text(c: Column) -> Column:
    """Accent-free lower-case words: letters, digits and dots, one space between."""
    text = F.lower(strip_accents(c))
    text = F.regexp_replace(text, "[-_/]+", " ")
    text = F.regexp_replace(text, "[^\\p{L}\\p{N}.]+", " ")
    return F.trim(text)


def words(norm: Column) -> Column:
    """Phrase tokens: split on spaces, so ``tp.hcm`` stays whole."""
    return F.filter(F.split(norm, " "), lambda t: t != "")


def dot_words(norm: Column) -> Column:
    """Index tokens: split on spaces and dots, so ``tp.hcm`` gives two."""
    return F.filter(F.split(norm, "[\\s.]+"), lambda t: t != "")


def tokenize(c: Column) -> Column:
    return dot_words(normalize_text(c))


def phrase_tokens(c: Column) -> Column:
    return words(normalize_text(c))


def squash(norm: Column) -> Column:
    """Drop the spaces of normalized text."""
    return F.replace(norm, F.lit(" "), F.lit(""))


def compact(c: Column) -> Column:
    return squash(normalize_text(c))


def padded(norm: Column) -> Column:
    return F.concat(F.lit(" "), norm, F.lit(" "))


def contains_token_phrase(norm: Column, phrase: Column) -> Column:
    return F.contains(padded(norm), padded(phrase))


def replace_token_phrase(norm: Column, phrase: Column, replacement: Column) -> Column:
    """Replace a token-bounded phrase everywhere, neighbours included.

    Doubling the spaces gives every token its own pair, so adjacent hits do not compete
    for the blank between them.
    """
    def widen(c: Column) -> Column:
        return padded(F.replace(c, F.lit(" "), F.lit("  ")))

    swapped = F.replace(widen(norm), widen(phrase), widen(replacement))
    return F.trim(F.regexp_replace(swapped, " +", " "))


def has_any(norm: Column, needles: list[str]) -> Column:
    """Raw substring test against fixed, already normalized needles."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(norm, F.lit(needle))
    return hit


def contains_any(c: Column, needles: list[str]) -> Column:
    """Substring test where both sides are normalized first."""
    return has_any(normalize_text(c), [plain(n) for n in needles])


def plain(value: str) -> str:
    """Driver-side twin of :func:`normalize_text` for rule constants."""
    import re

    text = unicodedata.normalize("NFD", value)
    text = "".join(ch for ch in text if not 0x300 <= ord(ch) <= 0x36F)
    text = text.replace("đ", "d").replace("Đ", "D").lower()
    text = re.sub(r"[-_/]+", " ", text)
    text = "".join(ch if ch.isalnum() or ch == "." else " " for ch in text)
    return re.sub(r" +", " ", text).strip()


def slug(c: Column) -> Column:
    """Dash-joined ascii id, ``place`` when nothing is left."""
    dashed = F.regexp_replace(normalize_text(c), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-|-$", ""), F.lit("")), F.lit("place"))


def stable_id(c: Column) -> Column:
    return F.concat(F.lit("generated:"), F.replace(normalize_text(c), F.lit(" "), F.lit("-")))


def street_from_address(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.split(c, ",")[0], "^\\d+\\s+", ""))


def is_coordinate_like(norm: Column) -> Column:
    return norm.rlike("^[0-9.\\s,]+$") & norm.rlike("[0-9]")


def grams(norm: Column, size: int = 3) -> Column:
    """Distinct character n-grams of a string, in first-seen order.

    Works on the array of characters: indexing into it is constant-time, while cutting
    substrings out of a long text rescans the text every time.
    """
    def body(chars: Column) -> Column:
        count = F.size(chars) - F.lit(size - 1)
        spans = F.transform(
            F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
            lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)]),
        )
        return F.when(count >= 1, F.array_distinct(spans)).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(norm, ""), lambda ch: ch != ""), body)


def trigrams(c: Column) -> Column:
    """Distinct trigrams over the compact text."""
    return grams(compact(c))


def dice(a: Column, b: Column) -> Column:
    def body(v: Column) -> Column:
        total = F.size(v["a"]) + F.size(v["b"])
        shared = F.size(F.array_intersect(v["a"], v["b"]))
        return F.when((F.size(v["a"]) == 0) | (F.size(v["b"]) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * shared / total)

    return let_all(body, a=a, b=b)


def longest(tokens: Column) -> Column:
    """The longest token (first one on ties), or null."""
    return F.aggregate(
        tokens,
        F.lit(None).cast("string"),
        lambda best, t: F.when(best.isNull() | (F.length(t) > F.length(best)), t).otherwise(best),
    )


def deletions(token: Column) -> Column:
    """The token and all strings one deletion away: complete for edit distance one."""
    def body(t: Column) -> Column:
        cut = lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))
        return F.array_distinct(
            F.concat(F.array(t), F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), cut))
        )

    return let(token, body)

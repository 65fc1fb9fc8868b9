"""Plain versions of the operators, and awkward inputs."""

from __future__ import annotations

import re
import zlib

SF = "/root/testdata/sf0.001"


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def plain_words(text: str | None) -> list[str]:
    """Words as the library defines them: runs of ASCII letters, digits, underscores and non-ASCII characters."""
    return re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())


def plain_shingles(text: str | None, width: int = 5) -> set:
    w = plain_words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def awkward_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and then runs away from it all in the evening"
    rows = [
        (1, base, "en", "a", 1, "x"), (2, base, "en", "a", 1, "y"), (2, base, "en", "a", 1, "y"), (3, base.upper(), "en", None, 1, "z"), (4, None, "en", "b", None, None), (5, "", "de", "b", 0, None),
        (6, "   ", None, "b", 3, None), (7, "12 34 !?", "de", "c", 8, None), (None, base + " now", "en", "c", 2, None), (None, None, None, None, None, None), (8, long, "en", "c", 9, None),
        (9, long, "en", "d", 9, None), (10, long + " end", "fr", "d", 9, None), (11, "été à la plage", "fr", "d", 9, None), (12, "ÉTÉ À LA PLAGE", "fr", None, 9, None), (13, "a", "en", "e", 1, None), (14, "\n\n\n", "en", "e", 1, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, shard string")


def empty_documents(spark):
    return awkward_documents(spark).limit(0)

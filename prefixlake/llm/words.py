"""Words of many texts at once, as 64-bit hashes.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters,
lower-cased. All of it is array work over the UTF-8 bytes of a batch.
"""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, dtype=bool)
for _c in range(256):
    _WORD[_c] = _c >= 0x80 or chr(_c).isalnum() or chr(_c) == "_"
_BASE = 0x100000001B3
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and where each text's words begin (one more at the end)."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_at = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    first = np.searchsorted(starts, text_at)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    length = ends - starts
    powers = np.cumprod(np.concatenate([[1], np.full(int(length.max()) - 1, _BASE, dtype=np.uint64)]).astype(np.uint64))
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    values = (data[inside].astype(np.uint64) + _U(1)) * powers[place]
    return mix(np.add.reduceat(values, at) + length.astype(np.uint64)), first


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words; of a shorter text, one of all its words."""
    words, first = word_hashes(texts)
    joined = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for i in range(width):
        joined = (joined + words[i : len(words) - width + 1 + i]) * _U(_BASE) if len(joined) else joined
    joined = mix(joined)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            h = _U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = (h + w) * _U(_BASE)
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out

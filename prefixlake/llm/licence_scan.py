"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph is a line of the text. Its word n-grams (1 to 3) that occur in any template are the
features of a multinomial logistic regression over the licence families and a class for anything
else. It is trained on variations of the templates (words lost, case, what stands around them)
against ordinary paragraphs: the shuffled words of templates, and a bounded sample of the corpus,
one paragraph each of the SAMPLE_ROWS rows with the smallest hash of the id. The unknown class is
calibrated on variations and paragraphs kept out of training: the scores are divided by the
temperature with the best likelihood. A prediction stands if its calibrated probability reaches
MIN_CHANCE, and is confirmed if the paragraph holds MIN_COVER of the word pairs of a template of
that family.

Statements wrapped over lines, and further families in one line, are found in windows of words: the
runs of lines between lines without a word are searched for stretches that hold MIN_COVER of the
word pairs of any template, and each stretch, with MARGIN words around it, is classified by itself.
Signs that mark comments are no words, so they do not part a statement. What a stretch over several
lines explains replaces the findings of those lines, unless one of them is confirmed for its family.

Defined results: null and empty texts have no finding; a text with repeated paragraphs has one
finding for each; a stretch is named by the line it starts in; positions count code points of the text as it is; without a corpus the unknown
class learns from shuffled words alone.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import chunks_of
from prefixlake.llm.words import mix, word_hashes

# Short statements by which public licences are named or granted.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT", "Licensed under the MIT license."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
OTHER = "unknown"
SAMPLE_ROWS, SAMPLE_WORDS = 2000, 60
VARIATIONS = 60
MIN_CHANCE, MIN_COVER = 0.5, 0.6
ORDERS = (1, 2, 3)
#: Words around a stretch that are classified with it: they may hold what tells families apart.
MARGIN = 3
WORD = re.compile("[A-Za-z0-9_\u0080-\U0010ffff]+")
SPAN = 1 << 20
_U = np.uint64


@dataclass
class Model:
    families: list[str]
    vocabulary: np.ndarray  # sorted hashes of n-grams
    filter_: np.ndarray  # which low bits of a hash occur in the vocabulary
    weights: np.ndarray  # n-grams x (families and unknown)
    bias: np.ndarray
    temperature: float
    pairs: list[tuple[int, np.ndarray]]  # of each template: family, sorted hashes of its word pairs


def _ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: hashes of the n-grams, and the text each is in."""
    words, first = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    running = words
    for order in ORDERS:
        if order > 1:
            running = mix(running[:-1] * _U(0x100000001B3) + words[order - 1 :]) if len(running) else running
        same = owner[: len(running)] == owner[order - 1 : order - 1 + len(running)]
        yield running[same] + _U(order), owner[: len(running)][same]


def _features(texts: list[str], vocabulary: np.ndarray, filter_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) pairs of the vocabulary, as two arrays ordered by text."""
    rows, cols = [], []
    for hashes, owner in _ngrams(texts):
        hit = np.flatnonzero(filter_[hashes & _U(len(filter_) - 1)])
        at = np.minimum(np.searchsorted(vocabulary, hashes[hit]), len(vocabulary) - 1)
        true = vocabulary[at] == hashes[hit]
        rows.append(owner[hit[true]])
        cols.append(at[true])
    pairs = np.unique(np.concatenate(rows) * len(vocabulary) + np.concatenate(cols))
    return pairs // len(vocabulary), pairs % len(vocabulary)


def _logits(model: Model, texts: list[str]) -> np.ndarray:
    out = np.tile(model.bias, (len(texts), 1))
    row, col = _features(texts, model.vocabulary, model.filter_)
    if len(row):
        which, start = np.unique(row, return_index=True)
        out[which] += np.add.reduceat(model.weights[col], start, axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _cover(model: Model, text: str, family: int) -> float:
    """Largest share of a template's word pairs that the paragraph holds."""
    words, _ = word_hashes([text])
    have = mix(words[:-1] * _U(0x100000001B3) + words[1:])
    return max((float(np.isin(pairs, have).mean()) for f, pairs in model.pairs if f == family and len(pairs)), default=0.0)


def train(paragraphs: list[str], seed: int = 5) -> Model:
    """Fit on variations of the templates against ``paragraphs`` and shuffled words."""
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    templates = [(families.index(f), t) for f in families for t in TEMPLATES[f]]
    vocabulary = np.unique(np.concatenate([h for h, _ in _ngrams([t for _, t in templates])]))
    filter_ = np.zeros(1 << 20, dtype=bool)
    filter_[vocabulary & _U(len(filter_) - 1)] = True
    ordinary = [p for p in paragraphs if not re.search(r"licen[cs]|copyright|rights reserved|spdx", p, re.I)]
    around = [" ".join(p.split()[:8]) for p in ordinary] or [""]
    every = [w for _, t in templates for w in t.split()]
    texts, labels = [], []
    for family, t in templates:
        for i in range(VARIATIONS):
            words = [w for w in t.split() if i < 5 or rng.random() > 0.08] or t.split()
            s = " ".join(words)
            s = rng.choice([s, s, s.lower(), s.upper()])
            texts.append(" ".join([rng.choice(around), s, rng.choice(around)] if rng.random() < 0.4 else [s]))
            labels.append(family)
    for i in range(20 * len(families)):
        texts.append(" ".join(rng.sample(every, rng.randint(1, 8)) + rng.choice(around).split()))
        labels.append(len(families))
    texts += ordinary
    labels += [len(families)] * len(ordinary)
    kept_out = np.array([rng.random() < 0.25 for _ in texts])
    y = np.array(labels)
    row, col = _features(texts, vocabulary, filter_)
    x = np.zeros((len(texts), len(vocabulary)), dtype=np.float32)
    x[row, col] = 1
    weights, bias = np.zeros((len(vocabulary), len(families) + 1), dtype=np.float32), np.zeros(len(families) + 1, dtype=np.float32)
    bias[-1] = 3.0  # nothing known speaks for unknown
    fit, target = x[~kept_out], np.eye(len(families) + 1, dtype=np.float32)[y[~kept_out]]
    speed = np.zeros_like(weights)
    for _ in range(150):
        d = (_softmax(fit @ weights + bias) - target) / len(fit)
        speed = 0.9 * speed + fit.T @ d + 1e-5 * weights
        weights -= 4.0 * speed
        bias -= 0.5 * d.sum(axis=0)
    z = x[kept_out] @ weights + bias
    held = y[kept_out]
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), held] + 1e-12).mean()) if len(held) else 1.0
    pairs = []
    for family, t in templates:
        words, _ = word_hashes([t])
        pairs.append((family, np.unique(mix(words[:-1] * _U(0x100000001B3) + words[1:]))))
    return Model(families, vocabulary, filter_, weights, bias, temperature, pairs)


def classify(model: Model, paragraphs: list[str]) -> list[tuple[int, str, float, float]]:
    """(paragraph, family, probability, cover) of every paragraph that is not unknown."""
    out = []
    z = _logits(model, paragraphs)
    likely = np.flatnonzero(z.argmax(axis=1) < len(model.families))
    if len(likely):
        p = _softmax(z[likely] / model.temperature)
        for i, chances in zip(likely.tolist(), p, strict=True):
            family = int(chances[:-1].argmax())
            if chances[family] >= MIN_CHANCE:
                out.append((i, model.families[family], float(chances[family]), _cover(model, paragraphs[i], family)))
    return out


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Where the runs of lines that hold a word begin and end."""
    at, begin = 0, None
    for line in text.split("\n"):
        if WORD.search(line):
            begin = at if begin is None else begin
            end = at + len(line)
        elif begin is not None:
            yield begin, end
            begin = None
        at += len(line) + 1
    if begin is not None:
        yield begin, end


def _stretches(pairs: np.ndarray, template: np.ndarray) -> list[tuple[int, int, int]]:
    """(word pairs held, first, last word) of the best stretches of a block that do not overlap."""
    need, width = max(1, int(np.ceil(MIN_COVER * len(template)))), 2 * len(template) + 4
    at = np.flatnonzero(np.isin(pairs, template))
    which = np.searchsorted(template, pairs[at])
    found = []
    for i in range(len(at)):
        seen: set[int] = set()
        last = i
        for j in range(i, len(at)):
            if at[j] - at[i] >= width:
                break
            if which[j] not in seen:
                seen.add(which[j])
                last = j
        if len(seen) >= need:
            found.append((len(seen), int(at[i]), int(at[last]) + 1))
    return _apart(sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])))


def _apart(ranked: list[tuple]) -> list[tuple]:
    """Those of (.., first, last, ..) that overlap none before them."""
    taken: list[tuple[int, int]] = []
    out = []
    for f in ranked:
        k = bisect.bisect(taken, (f[1], f[2]))
        if (k == 0 or taken[k - 1][1] < f[1]) and (k == len(taken) or taken[k][0] > f[2]):
            taken.insert(k, (f[1], f[2]))
            out.append(f)
    return out


def windows(model: Model, blocks: list[str]) -> list[tuple[int, int, int, str, float, float]]:
    """(block, start, end, family, probability, cover) of every stretch that passes both tests."""
    words, first = word_hashes(blocks)
    if len(words) < 2:
        return []
    pairs = mix(words[:-1] * _U(0x100000001B3) + words[1:])
    owner = np.repeat(np.arange(len(blocks)), np.diff(first))
    known = np.unique(np.concatenate([p for _, p in model.pairs]))
    place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    hit = np.flatnonzero((known[place] == pairs) & (owner[:-1] == owner[1:]))
    both = np.unique(owner[hit] * len(known) + place[hit])
    block, pair = both // len(known), both % len(known)
    texts, out, spots = [], [], {}
    for family, template in model.pairs:
        held = np.bincount(block[np.isin(known[pair], template)], minlength=len(blocks))
        for b in np.flatnonzero(held >= max(1, MIN_COVER * len(template))).tolist():
            spots[b] = spots.get(b) or [m.span() for m in WORD.finditer(blocks[b])]
            for n, i, j in _stretches(pairs[first[b] : first[b + 1] - 1], template):
                texts.append(blocks[b][spots[b][max(0, i - MARGIN)][0] : spots[b][min(len(spots[b]) - 1, j + MARGIN)][1]])
                out.append((n, spots[b][i][0], spots[b][j][1], b, family, n / len(template)))
    if not texts:
        return []
    chance = _softmax(_logits(model, texts) / model.temperature)
    sure = [(*f, float(chance[k, f[4]])) for k, f in enumerate(out) if chance[k, f[4]] >= MIN_CHANCE]
    by: dict[int, list[tuple]] = {}
    for f in sorted(sure, key=lambda f: (-f[0], -f[6], f[1])):
        by.setdefault(f[3], []).append(f)
    return [(b, f[1], f[2], model.families[f[4]], f[6], f[5]) for b in sorted(by) for f in sorted(_apart(by[b]), key=lambda f: f[1])]


def merged(lines: list[tuple], stretches: list[tuple]) -> list[tuple]:
    """Findings (paragraph, start, end, family, probability, cover, confirmed, last paragraph) of one text, in order."""
    for s in stretches:
        over = [x for x in lines if s[0] <= x[0] <= s[7]]
        if any(x[3] == s[3] and x[6] for x in over):
            continue
        if s[7] > s[0]:
            gone = [x for x in over if x[3] == s[3] or 2 * (min(x[2], s[2]) - max(x[1], s[1])) >= x[2] - x[1]]
            lines = [x for x in lines if x not in gone]
        lines = [*lines, s]
    return sorted(lines, key=lambda x: x[:4])


def fit(docs: DataFrame, text: str = "text", row_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Train with one paragraph each of the rows with the smallest hash of the id, at most ``rows``."""
    lines = F.split(F.col(text), "\n")
    line = F.element_at(lines, (F.pmod(F.xxhash64(F.lit("line"), F.col(row_id).cast("string")), F.size(lines)) + 1).cast("int"))
    words = F.array_join(F.slice(F.split(line, " "), 1, SAMPLE_WORDS), " ")
    order = F.xxhash64(F.lit("sample"), F.col(row_id).cast("string"))
    taken = docs.filter(F.col(text).isNotNull()).select(order.alias("o"), F.left(words, F.lit(10 * SAMPLE_WORDS)).alias("p")).orderBy("o", "p").limit(rows).collect()
    return train([r["p"] for r in taken])


def scan(docs: DataFrame, model: Model, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """A row per licence paragraph or stretch: doc_id, paragraph, start, end, family, probability, cover, confirmed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["paragraph", "start", "end", "family", "probability", "cover", "confirmed"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    schema = slim.select("doc_id", *[F.lit(None).cast(k).alias(n) for n, k in zip(names, ["int", "long", "long", "string", "double", "double", "boolean"], strict=True)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            owners: list[int] = []
            out: list[tuple] = []
            for a, b in chunks_of(texts, [len(t) for t in texts], SPAN):
                lines, where, starts, blocks, block_at = [], [], {}, [], []
                for d in range(a, b):
                    at = 0
                    starts[d] = []
                    for i, line in enumerate(texts[d].split("\n")):
                        lines.append(line)
                        where.append((d, i, at))
                        starts[d].append(at)
                        at += len(line) + 1
                    for begin, end in _blocks(texts[d]):
                        blocks.append(texts[d][begin:end])
                        block_at.append((d, begin))
                found: dict[int, tuple[list, list]] = {}
                for k, family, chance, cover in classify(shared.value, lines):
                    d, i, at = where[k]
                    found.setdefault(d, ([], []))[0].append((i, at, at + len(lines[k]), family, chance, cover, cover >= MIN_COVER, i))
                for k, begin, end, family, chance, cover in windows(shared.value, blocks):
                    d, at = block_at[k]
                    i, last = (bisect.bisect(starts[d], at + x) - 1 for x in (begin, end - 1))
                    found.setdefault(d, ([], []))[1].append((i, at + begin, at + end, family, chance, cover, True, last))
                for d in sorted(found):
                    rows = merged(*found[d])
                    owners += [d] * len(rows)
                    out += [r[:7] for r in rows]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    return slim.mapInArrow(run, schema)

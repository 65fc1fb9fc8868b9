"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of 1 to 3 code points per language over *all* labelled rows in
one aggregation; the matrix of log-probabilities (languages x buckets, checked) is broadcast;
texts are scored in batches with one gather and one segmented sum.

Defined results: a null text, an empty text and a text without any letter are ``und`` with
score 0; equal scores go to the language that sorts first; without any training row every text
is ``und``. Null languages are not learned. Extra input columns pass through; a column with the
name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlake.llm.common import chunks_of, stored

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 14
#: Languages counted at once by a task; beyond, it hands on what it has and starts again.
HELD = 64
#: Bound of the broadcast matrix in bytes.
MAX_MATRIX = 256 << 20
#: Code points scored together.
SPAN = 1 << 18
_MULTIPLIER = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, float32
    prior: np.ndarray


def ngram_buckets(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: the bucket of each n-gram, and where each text's n-grams begin.

    Texts are lower-cased and stand between two spaces, so every text has an n-gram of each order.
    """
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(p) for p in padded])
    starts = np.concatenate([[0], ends[:-1]])
    mixed = points * _MULTIPLIER[0]
    mixed ^= mixed >> np.uint32(15)
    running = mixed.copy()
    for order in ORDERS:
        if order > 1:
            running = running[:-1] * _MULTIPLIER[order - 1] + mixed[order - 1 :]
        keep = np.ones(len(running), dtype=bool)
        for back in range(1, order):  # n-grams that would reach into the next text
            cut = ends - back
            keep[cut[cut < len(running)]] = False
        buckets = (running * _MULTIPLIER[2] >> np.uint32(32 - bits))[keep] if order > 1 else running * _MULTIPLIER[2] >> np.uint32(32 - bits)
        yield buckets, starts - (order - 1) * np.arange(len(texts))


def _counts(bits: int):
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows[lang]))], ["lang", "bucket", "n"])
            held.clear()
            rows.clear()

        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                total = held.setdefault(lang, np.zeros(size, dtype=np.int64))
                rows[lang] = rows.get(lang, 0) + len(texts)
                for a, b in chunks_of(texts, [len(t) for t in texts], SPAN):
                    for buckets, _ in ngram_buckets(texts[a:b], bits):
                        total += np.bincount(buckets, minlength=size)
            if len(held) > HELD:
                yield from flush()
        yield from flush()

    return count


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, smoothing: float = 0.5) -> Model | None:
    """Learn from every row with a language and a text; None if there is none."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = stored(rows.mapInArrow(_counts(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = [r["lang"] for r in totals.select("lang").distinct().orderBy("lang").limit(MAX_MATRIX // (4 << bits) + 1).collect()]
    if len(languages) * (4 << bits) > MAX_MATRIX:
        raise ValueError(f"more than {MAX_MATRIX // (4 << bits)} languages: the matrix would not fit a broadcast")
    if not languages:
        return None
    index = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((1 << bits, len(languages)))
    seen = np.zeros(len(languages))
    table = totals.toPandas()  # at most languages x buckets rows
    column, bucket = table["lang"].map(index).to_numpy(), table["bucket"].to_numpy()
    is_row = bucket < 0
    seen[column[is_row]] = table["n"].to_numpy()[is_row]
    counts[bucket[~is_row], column[~is_row]] = table["n"].to_numpy()[~is_row]
    weights = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * (1 << bits)))
    return Model(languages, weights.astype(np.float32), np.log(seen / seen.sum()))


def score_texts(model: Model | None, texts: list[str | None], bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for a, b in chunks_of(at, [len(texts[i]) for i in at], SPAN):
        group = at[a:b]
        total = np.tile(model.prior, (len(group), 1))
        for buckets, starts in ngram_buckets([texts[i] for i in group], bits):
            total += np.add.reduceat(np.take(model.weights, buckets, axis=0), starts, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        chance = 1 / odds.sum(axis=1)
        for i, k, p in zip(group, best, chance, strict=True):
            names[i], scores[i] = model.languages[k], p
    return names, scores


def predict(docs: DataFrame, model: Model | None, text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    base = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score_texts(shared.value, batch.column(text).to_pylist(), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)

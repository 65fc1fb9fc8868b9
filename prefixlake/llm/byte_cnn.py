"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded, learned filters slide over every window of the text, and the responses are
max-pooled in chunks of POOL windows; neighbouring chunks share the bytes their windows overlap,
so no window is left out. A small hidden layer describes each chunk, and the mean and the
maximum over all chunks of the whole document give one probability.

Training uses a bounded sample of labelled rows: at most SAMPLE_ROWS, those with the smallest
hash of the id, and of each at most CROPS evenly placed pieces of CROP bytes. Scoring reads whole
texts, in slabs of bounded size.

Defined results: a null text counts as empty and an empty text is scored like one zero byte;
null labels are not learned; without any labelled row every score is 0.5. Extra columns pass
through; a column with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS, CROPS, CROP = 3000, 4, 1024
EMBED, WIDTH, FILTERS, POOL, HIDDEN = 4, 8, 24, 64, 12
STEPS, BATCH = 600, 32
#: Windows convolved at once, a multiple of POOL.
SLAB = 64 * POOL
Weights = dict[str, np.ndarray]


def initial(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)), "shift": np.zeros(FILTERS),
        "hidden": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), "lift": np.zeros(HIDDEN), "out": rng.normal(0, 0.1, (2 * HIDDEN,)), "bias": np.zeros(1),
    }


def windows_of(embedded: np.ndarray) -> np.ndarray:
    """Every run of WIDTH embedded bytes, as a row."""
    return np.ascontiguousarray(sliding_window_view(embedded.reshape(-1), WIDTH * EMBED)[::EMBED])


def _step(w: Weights, data: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Loss and gradient for documents of equal padded length; ``valid`` marks the windows that count."""
    n, length = data.shape
    windows = length - WIDTH + 1
    e = w["embed"][data]
    cols = np.concatenate([windows_of(x) for x in e])
    act = np.where(valid.reshape(-1, 1), cols @ w["filters"] + w["shift"], 0.0).reshape(n, windows // POOL, POOL, FILTERS)
    at = act.argmax(axis=2)
    pooled = np.maximum(np.take_along_axis(act, at[:, :, None, :], axis=2)[:, :, 0, :], 0)
    used = valid.reshape(n, -1, POOL).any(axis=2)
    hidden = np.where(used[:, :, None], np.maximum(pooled @ w["hidden"] + w["lift"], 0), 0.0)
    count = np.maximum(used.sum(axis=1), 1)[:, None]
    mean, top_at = hidden.sum(axis=1) / count, hidden.argmax(axis=1)
    joined = np.concatenate([mean, np.take_along_axis(hidden, top_at[:, None, :], axis=1)[:, 0, :]], axis=1)
    p = 1 / (1 + np.exp(-(joined @ w["out"] + w["bias"][0])))
    loss = -np.mean(np.log(np.where(label == 1, p, 1 - p) + 1e-9))
    d = (p - label) / n
    g: Weights = {"out": joined.T @ d, "bias": np.array([d.sum()])}
    dj = d[:, None] * w["out"]
    dh = np.repeat((dj[:, :HIDDEN] / count)[:, None, :], hidden.shape[1], axis=1)
    np.put_along_axis(dh, top_at[:, None, :], np.take_along_axis(dh, top_at[:, None, :], axis=1) + dj[:, None, HIDDEN:], axis=1)
    dh = np.where(hidden > 0, dh, 0.0)
    flat = dh.reshape(-1, HIDDEN)
    g["hidden"], g["lift"] = pooled.reshape(-1, FILTERS).T @ flat, flat.sum(axis=0)
    dp = np.where(pooled > 0, dh @ w["hidden"].T, 0.0)
    # only the window that won each pool gets a gradient
    doc, chunk, filt = np.nonzero(dp)
    value = dp[doc, chunk, filt]
    row = doc * windows + chunk * POOL + at[doc, chunk, filt]
    g["shift"] = np.bincount(filt, weights=value, minlength=FILTERS)
    part = cols[row] * value[:, None]
    order = np.argsort(filt, kind="stable")
    won, first = np.unique(filt[order], return_index=True)
    g["filters"] = np.zeros_like(w["filters"])
    if len(won):
        g["filters"][:, won] = np.add.reduceat(part[order], first, axis=0).T
    back = (w["filters"].T[filt] * value[:, None]).reshape(-1, WIDTH, EMBED)
    start = chunk * POOL + at[doc, chunk, filt]
    touched = data[doc[:, None], start[:, None] + np.arange(WIDTH)].ravel()
    g["embed"] = np.stack([np.bincount(touched, weights=back[:, :, c].ravel(), minlength=256) for c in range(EMBED)], axis=1)
    return float(loss), g


def padded(length: int) -> int:
    """Bytes of a document of ``length`` bytes filled up to whole chunks."""
    return -(-max(1, length - WIDTH + 1) // POOL) * POOL + WIDTH - 1


def train(pieces: list[list[bytes]], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Weights | None:
    """Adam over random pieces of the sampled documents, both classes equally often."""
    if not len(labels):
        return None
    rng, w = np.random.default_rng(seed), {k: x.astype(np.float32) for k, x in initial(seed).items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    by = [np.flatnonzero(labels == c) for c in (0, 1)]
    prior = len(by[1]) / len(labels)
    for t in range(1, steps + 1):
        pick = np.array([rng.choice(by[c]) for c in rng.integers(0, 2, BATCH) if len(by[c])], dtype=int)
        if not len(pick):
            continue
        chosen = [pieces[i][rng.integers(len(pieces[i]))] for i in pick]
        size = padded(max(map(len, chosen)))
        data, valid = np.zeros((len(pick), size), dtype=np.uint8), np.zeros((len(pick), size - WIDTH + 1), dtype=bool)
        for i, b in enumerate(chosen):
            data[i, : len(b)] = np.frombuffer(b, dtype=np.uint8)
            valid[i, : max(1, len(b) - WIDTH + 1)] = True
        _, g = _step(w, data, valid, labels[pick].astype(np.float32))
        rate = 0.008 * min(1, 3 * (1 - (t - 1) / steps))
        for k in w:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    # classes were drawn equally often: shift the last layer to their real shares
    w["bias"] = w["bias"] + np.log(np.clip(prior, 1e-3, 1 - 1e-3) / (1 - np.clip(prior, 1e-3, 1 - 1e-3))) / 2
    return {k: x.astype(np.float32) for k, x in w.items()}


def score_bytes(w: Weights | None, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 of each whole text."""
    if w is None or not texts:
        return np.full(len(texts), 0.5)
    sizes = [padded(len(t)) for t in texts]
    chunks = np.array([(s - WIDTH + 1) // POOL for s in sizes])
    # every document takes whole chunks; the windows between its end and the next one's start are masked
    flat = np.zeros(int(chunks.sum()) * POOL + WIDTH - 1, dtype=np.uint8)
    hidden = np.empty((int(chunks.sum()), HIDDEN), dtype=np.float32)
    live = np.zeros(int(chunks.sum()) * POOL, dtype=bool)
    begin = np.cumsum(chunks) - chunks
    for t, b in zip(texts, begin, strict=True):
        flat[b * POOL : b * POOL + len(t)] = np.frombuffer(t, dtype=np.uint8)
        live[b * POOL : b * POOL + max(1, len(t) - WIDTH + 1)] = True
    tails = {}
    for t, b, c in zip(texts, begin, chunks, strict=True):  # a text can reach past its chunks by a part of a window
        over = len(t) - c * POOL
        if over > 0:
            tails[int(b + c - 1)] = t[(c - 1) * POOL :]
    for at in range(0, len(live), SLAB):
        end = min(at + SLAB, len(live))
        e = w["embed"][flat[at : end + WIDTH - 1]]
        act = windows_of(e) @ w["filters"]
        dead = np.flatnonzero(~live[at:end])
        if len(dead):
            act[dead] = -np.inf
        pooled = np.maximum(act.reshape(-1, POOL, FILTERS).max(axis=1) + w["shift"], 0)
        hidden[at // POOL : end // POOL] = np.maximum(pooled @ w["hidden"] + w["lift"], 0)
    for chunk, tail in tails.items():  # its last chunk alone, with all its bytes
        data = np.zeros(POOL + WIDTH - 1, dtype=np.uint8)
        data[: len(tail)] = np.frombuffer(tail, dtype=np.uint8)
        cols = windows_of(w["embed"][data])[: max(1, len(tail) - WIDTH + 1)]
        hidden[chunk] = np.maximum(np.maximum((cols @ w["filters"] + w["shift"]).max(axis=0), 0) @ w["hidden"] + w["lift"], 0)
    mean = np.add.reduceat(hidden, begin, axis=0, dtype=np.float64) / chunks[:, None]
    logit = np.concatenate([mean, np.maximum.reduceat(hidden, begin, axis=0)], axis=1) @ w["out"].astype(np.float64) + float(w["bias"][0])
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", row_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Weights | None:
    """Train on the texts of the labelled ids with the smallest hash, at most ``rows``.

    The ids are chosen from ``labels`` alone; only the texts of those ids are then read. Rows that
    repeat an id, in either table, each count; null labels do not; equal hashes go by id and label.
    """
    value = F.coalesce(F.col(text), F.lit("")).cast("binary")
    room = F.greatest(F.octet_length(value) - CROP, F.lit(0))
    crops = F.transform(F.sequence(F.lit(0), F.when(room > 0, F.lit(CROPS - 1)).otherwise(F.lit(0))), lambda i: F.substring(value, F.floor(room * i / (CROPS - 1)).cast("int") + 1, F.lit(CROP)))
    order = F.xxhash64(F.lit("sample"), F.col(row_id).cast("string"))
    picked = labels.filter(F.col(label).isNotNull() & F.col(row_id).isNotNull()).select(order.alias("o"), F.col(row_id).alias("i"), F.col(label).cast("int").alias("y")).orderBy("o", "i", "y").limit(rows)
    taken = docs.select(F.col(row_id).alias("i"), crops.alias("c")).join(F.broadcast(picked), "i").orderBy("o", "i", "y", "c").limit(rows).collect()
    return train([[bytes(c) for c in r["c"]] for r in taken], np.array([r["y"] for r in taken], dtype=int))


def score(docs: DataFrame, weights: Weights | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    base = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from prefixlake.llm.common import chunks_of

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()]
            parts = [score_bytes(shared.value, texts[a:b]) for a, b in chunks_of(texts, [len(t) for t in texts], 1 << 20)]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(run, schema)

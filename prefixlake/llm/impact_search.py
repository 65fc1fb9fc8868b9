"""Exact top-k inner product by an impact-ordered, score-at-a-time index.

Vectors become integers, floor(scale * x). The index holds blocks of rows; in a block each
component is a posting (row, dimension) with a quantised impact, and postings are processed for
a block of queries in tiers of descending impact. After a tier every row has a lower and an
upper bound: what is processed, give or take the quantisation error, and what is left, by the
greatest impact still to come. Processing stops only when the rows whose upper bound reaches the
k-th best lower bound (or the k-th exact score found before) are few, or nothing is left; those
possible members, and all ties, are rescored exactly.

Queries and index rows meet block by block: query blocks are joined to index blocks on (query
block, slot), so neither side is ever whole in a task or on the driver.

Defined results: vectors that are null or hold a null or a non-finite component take no part;
a shorter vector counts as filled up with zeros; rows that repeat an id are all candidates, but
never of a query with that id; of repeated query ids the vector that sorts first asks; ties go
to the smaller id. Null ids take no part. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.common import spread

LEVELS = 64
#: Lowest quantised level of each tier, of LEVELS; the last takes in all.
TIERS = (24, 12, 6, 3, 0)
QUERY_BLOCK = 4096
INDEX_BLOCK = 2048
#: Queries of a block that are worked on at a time.
SLICE = 256
#: Possible members per query, besides k, that are rescored without looking for a sharper bound.
FEW = 48


def _matrix(vectors: list, scale: float) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def _pack(scale: float, rows: int, slots: int):
    schema = ["ids", "values", "width", "slot"]

    def emit(ids: list, vectors: list, slot: int) -> pa.RecordBatch:
        m = _matrix(vectors, scale)
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, dtype=np.int64).tobytes()]), pa.array([m.tobytes()]), pa.array([m.shape[1]], pa.int32()), pa.array([slot], pa.int32())], names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += [np.array(v, dtype=np.float64) for v in batch.column(1).to_pylist()]
            while len(ids) >= rows:
                yield emit(ids[:rows], vectors[:rows], ids[0] % slots)
                ids, vectors = ids[rows:], vectors[rows:]
        if ids:
            yield emit(ids, vectors, ids[0] % slots)

    return run


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray, safe: bool) -> list[int]:
    if safe:
        return np.einsum("ij,ij->i", q[qi].astype(np.int64), x[xi].astype(np.int64)).tolist()
    return [sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)) for i, j in zip(qi, xi, strict=True)]


def search_block(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor_: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query position, id, score) of each query's k best rows of a block, ties to the smaller id.

    ``floor_`` has, per query, a score that k other rows are known to reach; rows below it are left out.
    """
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    own = qids[:, None] == ids[None, :]
    size, top = np.abs(x), float(np.abs(x).max(initial=0))
    safe = top * float(np.abs(q).max(initial=0)) * max(width, 1) < 2**52
    possible = ~own
    if safe and top > 0:
        step = top / LEVELS
        level = np.minimum((size / step).astype(np.int16), LEVELS - 1)
        weight, done = np.abs(q), np.zeros_like(x, dtype=bool)
        score = np.zeros((len(q), len(x)))
        spent, mass = np.zeros_like(score), weight.sum(axis=1, keepdims=True)
        for least in TIERS:
            tier = (level >= least) & ~done
            done |= tier
            if tier.any():
                score += q @ np.where(tier, np.sign(x) * (level + 0.5) * step, 0.0).T
                spent += weight @ tier.T.astype(np.float64)
            error = spent * (step / 2) + (mass - spent) * (least * step) + 1e-6 * (1 + mass * top)
            low = np.where(own, -np.inf, score - error)
            bound = np.partition(low, -k, axis=1)[:, -k] if len(x) >= k else np.full(len(q), -np.inf)
            possible = (score + error >= np.maximum(bound, floor_)[:, None]) & ~own
            if possible.sum(axis=1).max(initial=0) <= k + FEW:
                break
    qi, xi = np.nonzero(possible)
    scores = _exact(q, x, qi, xi, safe)
    keys = np.array(scores, dtype=np.int64 if safe else object)
    order = sorted(range(len(qi)), key=lambda i: (qi[i], -scores[i], ids[xi[i]])) if not safe else np.lexsort((ids[xi], -keys, qi))
    order = np.array(order, dtype=np.int64)
    qi, xi, keys = qi[order], xi[order], keys[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    keep = (place < k) & (keys >= np.where(np.isfinite(floor_[qi]), floor_[qi], -(2**63)) if safe else np.ones(len(qi), dtype=bool))
    return qi[keep], ids[xi[keep]], [int(s) for s in keys[keep]]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # per query block: the k best scores found by this task
        for batch in batches:
            for row in batch.to_pylist():
                qids, ids = np.frombuffer(row["qids"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64)
                q = np.frombuffer(row["qvalues"]).reshape(len(qids), row["qwidth"])
                x = np.frombuffer(row["values"]).reshape(len(ids), row["width"])
                mine = best.setdefault(row["query_block"], np.full((len(qids), k), -np.inf))
                for at in range(0, len(qids), SLICE):
                    part = slice(at, at + SLICE)
                    qi, found, scores = search_block(qids[part], q[part], ids, x, k, mine[part].min(axis=1))
                    first = np.flatnonzero(np.diff(qi, prepend=-1))
                    for a, b in zip(first, np.append(first, len(qi))[1:], strict=True):
                        mine[at + qi[a]] = np.sort(np.concatenate([mine[at + qi[a]], np.array(scores[a:b], dtype=np.float64)]))[-k:]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[part][qi]), pa.array(found), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over ``vectors``."""
    n = spread(vectors)

    def usable(df: DataFrame) -> DataFrame:
        value = F.col(embedding).cast("array<double>")
        fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.select(F.col(vec_id).cast("long").alias("id"), value.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)

    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    index = usable(vectors).mapInArrow(_pack(scale, INDEX_BLOCK, n), "ids binary, values binary, width int, slot int").withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = asked.withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def pack_queries(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        m = _matrix([np.array(v, dtype=np.float64) for v in table.column("v").to_pylist()], scale)
        return pa.table({"query_block": pa.array([key[0].as_py()], pa.int32()), "qids": [np.array(table.column("id"), dtype=np.int64).tobytes()], "qvalues": [m.tobytes()], "qwidth": pa.array([m.shape[1]], pa.int32())})

    packed = dealt.groupBy("query_block").applyInArrow(pack_queries, "query_block int, qids binary, qvalues binary, qwidth int").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = ["query_block", "slot"]
    pairs = index.repartition(n, *keys).join(packed.repartition(n, *keys), keys)
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Approximate cosine neighbours: inverted cells, product-quantised residuals, exact rescoring.

Coarse centres and code books are fitted on a bounded sample (at most SAMPLE vectors); every vector is
indexed. A vector belongs to the cell of its nearest centre and is written as one byte per group of
dimensions of its residual. A query looks into its nearest cells, is compared with what the codes stand
for, and only the best candidates of a query in a block are scored exactly, in the same task.

How many cells a query looks into is measured on the sample: as many as hold the neighbours of its
vectors with the wanted probability. The sample is thinner than the data, so neighbours are farther away in
it and the number errs to the safe side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefixlake.functions.num import round3
from prefixlake.operators.vectors import CHUNK, _found, best_of, block_rows, cell_blocks, meet_blocks, visited_scores
from prefixlake.session import hold

#: Vectors the centres and code books are fitted on; the only bound on what is read, and on the fit alone.
SAMPLE = 16384
MAX_CELLS, GROUP, CODES, ROUNDS = 1024, 4, 256, 8
#: Sample vectors that ask when the number of cells to look into is measured.
ASKED = 512
#: Candidates of a query in a block that are scored exactly, per neighbour asked for.
REFINE = 10


@dataclass(frozen=True)
class DenseModel:
    centers: np.ndarray  # cells x dimensions
    books: np.ndarray  # groups x codes x dimensions of a group
    probes: int


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = 0.5 * (centers * centers).sum(axis=1)
    return np.concatenate([(x[a : a + 4096] @ centers.T - half).argmax(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, dtype=int)])


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``x`` by Lloyd's rounds; a centre that loses all its points stays where it was."""
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        owner = _nearest(x, centers)
        count = np.bincount(owner, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _grouped(x: np.ndarray) -> np.ndarray:
    """Rows x groups x dimensions of a group, filled up with zeros."""
    width = -(-x.shape[1] // GROUP) * GROUP
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, GROUP)


def fit_dense(sample: np.ndarray, total: int, k: int = 10, wanted: float = 0.98, seed: int = 7) -> DenseModel:
    """Centres, code books and the number of cells to look into, from ``sample`` of ``total`` vectors."""
    rng = np.random.default_rng(seed)
    centers = _means(sample, max(1, min(MAX_CELLS, math.isqrt(total), len(sample))), rng)
    parts = _grouped(sample - centers[_nearest(sample, centers)])
    books = np.zeros((parts.shape[1], CODES, GROUP))
    for g in range(parts.shape[1]):
        found = _means(parts[:, g], CODES, rng)
        books[g, : len(found)] = found
        books[g, len(found) :] = found[0]
    asked = sample[rng.choice(len(sample), size=min(ASKED, len(sample)), replace=False)]
    sims = asked @ sample.T
    near = np.argsort(-sims, axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(-(asked @ centers.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.take_along_axis(place, _nearest(sample, centers)[near], axis=1)
    return DenseModel(centers, books, 1 + int(np.quantile(needed, wanted, method="higher")))


def encode(x: np.ndarray, model: DenseModel) -> tuple[np.ndarray, np.ndarray]:
    """Cell and codes of each vector."""
    cell = _nearest(x, model.centers)
    parts = _grouped(x - model.centers[cell])
    return cell, np.stack([_nearest(parts[:, g], model.books[g]) for g in range(parts.shape[1])], axis=1).astype(np.uint8)


def _sampled(vectors: DataFrame, total: int) -> np.ndarray:
    """At most SAMPLE vectors, chosen by the hash of id and vector."""
    if total > SAMPLE:
        share = int((SAMPLE / total) * 2**40)
        vectors = vectors.filter(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(2**40)) < share)
    rows = vectors.select("vec").limit(SAMPLE).collect()
    return np.array([r["vec"] for r in rows], dtype=float)


def decode(cell: np.ndarray, codes: np.ndarray, model: DenseModel) -> np.ndarray:
    """The vectors that cells and codes stand for."""
    parts = model.books[np.arange(codes.shape[1])[None, :], codes]
    return (model.centers[cell] + parts.reshape(len(codes), -1)[:, : model.centers.shape[1]]).astype(np.float32)


def _seen(queries: np.ndarray, model: DenseModel) -> np.ndarray:
    """(query, cell): the cells a query looks into."""
    order = np.argsort(-(queries @ model.centers.T), axis=1, kind="stable")[:, : model.probes]
    seen = np.zeros((len(queries), len(model.centers)), dtype=bool)
    np.put_along_axis(seen, order, True, axis=1)
    return seen


def _search(left: pd.DataFrame, right: pd.DataFrame, model: DenseModel, k: int, most: int) -> pd.DataFrame:
    """The ``most`` best of a block for each query by centre and codes; of those the ``k`` best by their exact cosine."""
    parts = []
    if len(left) and len(right):
        right = right.sort_values("cell")
        rows, ids, cell = np.stack(right["vec"].to_numpy()), right["vec_id"].to_numpy(), right["cell"].to_numpy()
        near = decode(cell, np.frombuffer(b"".join(right["codes"]), dtype=np.uint8).reshape(len(right), -1), model)
        for a in range(0, len(left), CHUNK):
            part = left.iloc[a : a + CHUNK]
            queries = np.stack(part["vec"].to_numpy())
            scores = visited_scores(queries.astype(np.float32), near, cell, _seen(queries, model))
            best = np.argpartition(-scores, most - 1, axis=1)[:, :most] if len(rows) > most else np.broadcast_to(np.arange(len(rows)), scores.shape)
            i, j = np.nonzero(np.isfinite(np.take_along_axis(scores, best, axis=1)))
            j = best[i, j]
            cosine = np.einsum("ij,ij->i", queries[i], rows[j])
            take = best_of(i, ids[j], cosine, k)
            parts.append((part["q_id"].to_numpy()[i[take]], ids[j[take]], cosine[take]))
    return _found(parts)


def approx_dense_knn(queries: DataFrame, vectors: DataFrame, k: int = 10, refine: int = REFINE, block: int | None = None) -> DataFrame:
    """Approximate cosine neighbours (q_id, vec_id, similarity, rank), similarity above zero.

    ``queries`` is (q_id, vec), ``vectors`` is (vec_id, vec), both unit length. Cells are put together to
    blocks of bounded size, or cut into several, and queries likewise. A task compares two blocks, scores
    the best candidates of each query exactly where they are, and gives ``k`` a query at most. An empty
    side gives an empty result.
    """
    spark = queries.sparkSession
    total = vectors.count()
    sample = _sampled(vectors, total)
    if not len(sample):
        return spark.createDataFrame([], "q_id bigint, vec_id bigint, similarity double, rank int")
    shared = spark.sparkContext.broadcast(fit_dense(sample, total, k))  # at most MAX_CELLS centres and 256 codes a group
    block = block or block_rows(total)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, codes = encode(np.stack(batch["vec"].to_numpy()), shared.value)
                yield batch.assign(cell=cell.astype("int32"), codes=[c.tobytes() for c in codes])

    coded = hold(vectors.select("vec_id", "vec").mapInPandas(index, "vec_id bigint, vec array<double>, cell int, codes binary"))
    places = cell_blocks({r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}, block)  # a row a centre

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                seen = _seen(np.stack(batch["vec"].to_numpy()), shared.value)
                for b in range(max(r.stop for r in places.values())):
                    who = seen[:, [c for c, r in places.items() if b in r]].any(axis=1)
                    if who.any():
                        yield batch[who].assign(block=np.int32(b))

    visits = queries.select("q_id", "vec").mapInPandas(visit, "q_id bigint, vec array<double>, block int")
    parts, most = max(1, -(-queries.count() // block)), max(1, refine * k)
    exact = meet_blocks(visits, coded, places, parts, lambda a, b: _search(a, b, shared.value, k, most), "q_id bigint, vec_id bigint, cosine double")
    order = W.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id")
    return (
        exact.select("q_id", "vec_id", round3(F.col("cosine")).alias("similarity")).filter("similarity > 0")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    )

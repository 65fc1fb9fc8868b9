"""Approximate neighbours against the exact ones, and the pairwise fit both ways."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixlake.operators import dense_index, learn, vectors
from prefixlake.rules import DEFAULT_WEIGHTS, FACTORS


def _recall(spark, df, **how):
    queries = df.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("q_id"), "vec")
    got = [tuple(r) for r in dense_index.approx_dense_knn(queries, df, **how).select("q_id", "vec_id", "similarity", "rank").collect()]
    rows = df.orderBy("vec_id").collect()
    units = np.array([r["vec"] for r in rows])
    ids = np.array([r["vec_id"] for r in rows])
    sims = np.floor(units @ units.T * 1000 + 0.5) / 1000
    place = {int(v): i for i, v in enumerate(ids)}
    reached = wanted = 0
    for q in [int(v) for v in ids if v % 5 == 0]:
        own = sims[place[q]]
        tenth = np.sort(own)[::-1][:10]
        mine = sorted((s for a, _, s, _ in got if a == q), reverse=True)
        wanted += int((tenth > 0).sum())
        reached += sum(1 for s in mine if s >= max(tenth[-1], 1e-9))
    for q, v, s, _ in got:  # what is found has its exact similarity
        assert abs(s - sims[place[q], place[v]]) < 0.0011
    return reached / wanted


def test_recall_on_the_embeddings_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    df = table.select("vec_id", vectors.unit(F.col("embedding")).alias("vec"))
    assert _recall(spark, df) >= 0.9


@pytest.mark.parametrize("width", [12, 13])
def test_recall_with_a_hot_cell_in_many_blocks(spark, width):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(900, width))
    data[300:] = data[300] + rng.normal(scale=0.05, size=(600, width))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id bigint, raw array<double>").select("vec_id", vectors.unit(F.col("raw")).alias("vec"))
    assert _recall(spark, df, block=32) >= 0.9


def test_empty_and_single_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, vec array<double>")
    queries = df.select(F.col("vec_id").alias("q_id"), "vec")
    assert [tuple(r) for r in dense_index.approx_dense_knn(queries, df).select("q_id", "vec_id", "similarity", "rank").collect()] == [(1, 1, 1.0, 1)]
    assert dense_index.approx_dense_knn(queries, df.limit(0)).count() == 0
    assert dense_index.approx_dense_knn(queries.limit(0), df).count() == 0


def test_fit_in_one_task_equals_the_fit_by_steps(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(*[round(rng.uniform(-1, 1), 3) for _ in FACTORS], rng.choice([1 / 3, 2 / 3, 1.0]), rng.randint(1, 4)) for _ in range(300)]
    deltas = spark.createDataFrame(rows, ",".join(f"{f} double" for f in FACTORS) + ", weight double, n bigint")
    one = learn.fit_pairwise(deltas, steps=20)
    monkeypatch.setattr(learn, "FIT_ROWS", 0)
    stepped = learn.fit_pairwise(deltas, steps=20)
    assert one.keys() == stepped.keys() and all(abs(one[f] - stepped[f]) < 1e-9 for f in FACTORS)
    assert learn.fit_pairwise(deltas.limit(0)) == pytest.approx(dict(DEFAULT_WEIGHTS))


def test_queries_travel_to_blocks_not_cells_and_ties_hold(spark):
    places = vectors.cell_blocks({0: 10, 1: 5, 2: 200, 3: 1}, 64)
    assert places == {0: range(0, 1), 1: range(0, 1), 2: range(0, 4), 3: range(3, 4)}
    rng = np.random.default_rng(4)
    data = rng.normal(size=(260, 6))
    data[:90] = data[0]  # a large group of copies: ties go to the smaller id
    units = data / np.linalg.norm(data, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(units)], "vec_id bigint, vec array<double>")
    found = vectors.dense_knn(df.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("q_id"), "vec"), df, k=5, n_pivots=12, block=64)
    sims = np.floor(units @ units.T * 1000 + 0.5) / 1000
    want = {(q, int(v), n + 1) for q in range(0, 260, 7) for n, v in enumerate(np.lexsort((np.arange(260), -sims[q]))[:5]) if sims[q, v] > 0}
    assert {(r["q_id"], r["vec_id"], r["rank"]) for r in found.collect()} == want

"""End-to-end rows of the suggestion job and checks of the operators without check SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixlake.functions.geo import haversine_m
from prefixlake.operators import learn, places, understand, vectors
from prefixlake.plans import suggest as plan
from prefixlake.rules import DEFAULT_WEIGHTS, FACTORS


@pytest.fixture(scope="module")
def outcome(spark, model):
    rows = [
        (1, "vin", None, None, None, None), (2, "cafe", None, None, None, "2024-05-01T23:30:00"), (3, "atm", None, 10.7751, 106.7035, None),
        (4, "10.77", None, None, None, None), (5, "pho", None, None, None, "2024-05-01T07:30:00"), (6, "caphe", "TP.HCM", None, None, None),
        (7, "", None, None, None, None), (8, "phong gym m c 2", None, None, None, None), (9, "vin", None, None, None, None),
    ]
    requests = spark.createDataFrame(rows, "request_id bigint, q string, city string, lat double, lon double, now string")
    return requests, plan.run(requests, model)


def test_suggestions(outcome):
    _, run = outcome
    intent = {r["request_id"]: r["type"] for r in run.intent.collect()}
    ranked = run.ranked.select("request_id", "rank", "text", "source", "factors.locality").collect()
    first = {r["request_id"]: r["text"] for r in ranked if r["rank"] == 1}
    assert first[1] == "Vincom Center" and intent[1] == "Brand Search"
    assert intent[4] == "Coordinate Search" and first[4] == "10.7769,106.7009"
    assert first[8] == "Phòng gym mở cửa 24/7"
    assert {r["source"] for r in ranked if r["request_id"] == 7} == {"popular-query"}
    by = lambda rid, text: next(r["locality"] for r in ranked if r["request_id"] == rid and text in r["text"])
    assert by(2, "24/7") == 1.0 and by(5, "Phở") == 0.96 and by(3, "ATM Vietcombank Nguyễn Huệ") == 1.0
    city = {r["request_id"]: r["city"] for r in run.contexts.collect()}
    assert city[3] == "TP.HCM"


def test_repeated_requests_share_a_context(outcome):
    requests, run = outcome
    assert run.contexts.count() == requests.count() - 1


def test_segmentation(spark, mini, model):
    asked = ["caphe", "cayxang", "benhvien", "khachsan", "nhathuoc", "cap"]
    rows = spark.createDataFrame([(t,) for t in asked], "token string")
    got = {r["token"]: r["segmented"] for r in understand.segment_tokens(rows, model.lexicon, mini.abbreviations).collect()}
    assert [got[t] for t in asked] == ["ca phe", "cay xang", "benh vien", "khach san", "nha thuoc", "ca phe"]


def test_pairwise_fit_matches_plain_loop(spark):
    rng = random.Random(5)
    rows = [(f"c{i % 6}", i, rng.choice([0, 1, 3]), tuple(round(rng.random(), 3) for _ in FACTORS)) for i in range(48)]
    schema = "case_id string, rank int, label int, factors struct<" + ",".join(f"{f}:double" for f in FACTORS) + ">"
    got = learn.fit_pairwise(learn.pairwise_deltas(spark.createDataFrame(rows, schema)), steps=12)
    pairs = [
        (np.array(a[3]) - np.array(b[3]), (a[2] - b[2]) / 3) for a in rows for b in rows if a[0] == b[0] and a[2] > b[2]
    ]
    base = np.array([DEFAULT_WEIGHTS[f] for f in FACTORS])
    w, rate = base.copy(), 0.16
    for _ in range(12):
        grad = sum((1 / (1 + math.exp(-float(w @ d))) - 1) * s * d for d, s in pairs) / len(pairs)
        w = np.maximum(0, w - rate * (grad + 0.025 * (w - base)))
        w, rate = w / w.sum(), rate * 0.993
    assert np.allclose([got[f] for f in FACTORS], w, atol=1e-9)


def test_range_join_is_whole(spark):
    rng = random.Random(3)
    spot = lambda: (rng.uniform(-89, 89), rng.choice([rng.uniform(-180, 180), rng.uniform(179.5, 180), rng.uniform(-180, -179.5)]))
    places_df = spark.createDataFrame([(f"p{i}", *spot()) for i in range(300)], "poi_id string, latitude double, longitude double")
    points = spark.createDataFrame([(i, *spot()) for i in range(200)], "request_id int, lat double, lon double")
    meters = 400_000.0
    got = places.range_pairs(points, places_df, meters, hot_rows=2).select("request_id", "poi_id")
    want = points.crossJoin(places_df).filter(haversine_m(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")) <= meters).select("request_id", "poi_id")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want) and rows(want)


def test_dense_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 12))
    data[50:120] = data[50] + rng.normal(scale=0.01, size=(70, 12))  # one hot cell
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id bigint, raw array<double>").withColumn("vec", vectors.unit(F.col("raw")))
    got = vectors.dense_knn(df.select(F.col("vec_id").alias("q_id"), "vec"), df.select("vec_id", "vec"), k=5, n_pivots=8, block=16)
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    sims = np.floor(units @ units.T * 1000 + 0.5) / 1000
    want = {(q, int(v)) for q in range(200) for v in np.lexsort((np.arange(200), -sims[q]))[:5] if sims[q, v] > 0}
    assert {(r["q_id"], r["vec_id"]) for r in got.collect()} == want

"""Queries over the shared suggestion run answer every request, with all a suggestion has."""

import uuid

import pytest
from pyspark.sql import functions as F

from prefixlake.operators import places
from prefixlake.plans import search
from prefixlake.plans import suggest as plan
from prefixlake.registry import all_queries
from prefixlake.registry import shared as S

ROWS = [
    (1, "vin", None, None, None, None, "1", 1), (2, "cafe", "TP.HCM", None, None, "2024-05-01T23:30:00", "2", 2), (3, "atm", None, 10.7751, 106.7035, None, "3", 3),
    (4, "vin", None, None, None, None, "1", 4), (5, "cafe", "TP.HCM", None, None, "2024-05-01T23:30:00", "2", 5), (6, "atm", None, 10.7751, 106.7035, None, "3", 6),
    (7, "", None, None, None, None, None, 7), (10, "nguyen hue", "hn", None, None, None, None, 8), (14, "nguyen hue", None, 16.061, 108.2446, None, None, 9),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(ROWS, "request_id bigint, q string, city string, lat double, lon double, now string, user_id string, cust bigint")


@pytest.fixture(scope="module")
def run(requests, model):
    return plan.run(requests.drop("cust"), model)


@pytest.fixture
def ask(monkeypatch, spark, mini, requests, run):
    monkeypatch.setattr(S, "catalog", lambda *_: mini)
    monkeypatch.setattr(S, "requests", lambda *_: requests)
    monkeypatch.setattr(S, "suggested", lambda *_: run)
    folder = uuid.uuid4().hex
    return lambda name: all_queries()[name](spark, folder).collect()


def test_every_request_has_an_intent(ask):
    got = {r.request_id: (r.type, r.confidence) for r in ask("e2_predict_intent")}
    assert set(got) == {r[0] for r in ROWS} and got[1] == got[4] and got[3] == got[6]


def test_explanations_reach_every_request_and_tell_the_enrichment(ask):
    rows = ask("e11_explain")
    told = {(r.request_id, r["rank"]): r.evidence for r in rows}
    assert {k for k, _ in told} == {r[0] for r in ROWS}
    assert all(told[4, n] == e for (k, n), e in told.items() if k == 1)
    place = [r.evidence for r in rows if r.summary.startswith("Highlands Coffee Nguyễn Huệ ") and "POI dataset row" in r.summary]
    assert place and all("Enrichment: " in e and "(provided-dataset)" in e for e in place)


def test_first_texts_of_every_request(ask, run):
    texts = {r.request_id: r.texts.split(" | ") for r in ask("e13_top_texts")}
    assert set(texts) == {r[0] for r in ROWS} and texts[2] == texts[5]
    first = {r.request_id: r.text for r in run.ranked.filter("rank = 1").collect()}
    assert all(texts[k][0] == v for k, v in first.items()) and max(map(len, texts.values())) == 5


def test_first_texts_are_not_cut_by_a_smaller_limit(spark, model, run):
    asked = spark.createDataFrame([(1, "cafe", 2)], "request_id bigint, q string, limit int")
    small = plan.run(asked, model)
    assert small.ranked.count() == 2 and len(plan.first_texts(small.best).first().texts) == 5


def test_place_rows_hold_all_fields_for_every_request(ask):
    rows = ask("j11_to_places")
    assert {r.request_id for r in rows} == {r[0] for r in ROWS}
    place = next(r for r in rows if r.id == "poi:P1")
    assert (place.label, place.rating, place.review_count, place.popularity_score) == ("Highlands Coffee Nguyễn Huệ", 4.3, 1250, 88.0)
    assert "openingHours" not in place.fields and "coordinates" in place.fields and "quality:good-rating" in place.attributes
    assert place.summary_evidence.startswith("label;category;address;rating") and '"lexical":' in place.score_factors and place.suggestion_type
    assert all(r.fields is None for r in rows if r.id.startswith("suggestion:"))


def test_search_takes_twelve_suggestions_and_all_keyword_hits_of_every_request(spark, requests, run, mini, ask):
    """Against a merge of all suggestions and all keyword hits, request by request."""
    more = [(f"N{i}", f"Nguyễn Huệ {i}", "ATM" if i % 2 else "Chợ", "", f"{i} Nguyễn Huệ, {'Hà Nội' if i % 3 else 'TP.HCM'}", "Hà Nội", 10.0 + i / 50, 106.0, 4.0, 100, 50 + i % 9, ["atm"], 100 + i) for i in range(60)]
    pois = mini.pois.unionByName(spark.createDataFrame(more, mini.pois.schema))
    asked = search.with_filters(requests.drop("cust")).withColumns({
        "radius_m": F.when(F.col("request_id") % 3 == 0, 60000.0), "bbox": F.when(F.col("request_id") % 5 == 0, "102,8,107,20"), "want_category": F.when(F.col("request_id") % 7 == 0, "chợ"),
    })
    ranked = plan.fan_out(requests.drop("cust"), run.best)
    hits = search._keyword_places(places.keyword_search(run.forms, pois), pois)
    merged = places.merge_places(places.to_places(ranked), asked.select("request_id", "q").join(hits, "q").drop("q"))
    context = asked.join(run.forms.select("q", "norm"), "q").select("request_id", "norm", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("city").alias("want_city"), *search.FILTERS)
    scored = places.rescore_proximity(merged.join(context, "request_id"))
    shown = ["request_id", "rank", "id", "name", "score", "distance_m"]
    want = sorted(map(str, places.order_search(places.scope_city(places.filter_places(scored)), 10).select(*shown).collect()))
    got = sorted(map(str, search.search_run(asked, run, pois, 10).select(*shown).collect()))
    assert got == want and len({r.split(",")[0] for r in got}) >= 7 and any("id='poi:N" in r for r in got)
    twice = pois.unionByName(pois.filter("poi_id = 'N7'"))
    assert search.search_run(asked, run, twice, 10).count() == len(want)
    # the copy of a request has its places; filters that leave none leave no row
    found = {r.request_id for r in ask("j12_search")}
    assert found >= {1, 2, 4, 5} and found <= {r[0] for r in ROWS}


def test_union_takes_all_sources(spark, mini, monkeypatch):
    asked = [(1, "cafe"), (2, "ca phe wifi da nang"), (3, "vin"), (4, "")]
    rows = spark.createDataFrame([(*r, None, None, None, None, 1) for r in asked], "request_id bigint, q string, city string, lat double, lon double, now string, cust bigint")
    monkeypatch.setattr(S, "catalog", lambda *_: mini)
    monkeypatch.setattr(S, "requests", lambda *_: rows)
    got = all_queries()["d9_union_candidates"](spark, uuid.uuid4().hex).collect()
    # before, no source beyond these four
    assert len({r.source for r in got} - {"autocomplete", "poi", "popular-query", "template"}) >= 2
    # without a query the popular rows alone
    assert {r.source for r in got if r.request_id == 4} == {"popular-query"}

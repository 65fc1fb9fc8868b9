"""The city filter and the direct evidence against plain loops, and the rows they hand to one task."""

from pyspark.sql import functions as F

from prefixlake.operators.cities import filter_city
from prefixlake.operators.intent import direct_evidence_intent
from prefixlake.operators.retrieve import POI


def _poi(city):
    return None if city is None else (None, None, None, None, city, None, None, None, None, None, None, None, None)


def test_filter_city_keeps_what_fits_and_shares_no_null_key(spark):
    rows = [
        ("a", "1", "pho ha noi", "history", [], None), ("a", "2", "pho", "matched in Đà Nẵng", [], None), ("a", "3", "pho", "x", ["hue"], None),
        ("a", "4", "pho", "x", [], _poi("Hà Nội")), ("a", "5", "pho", "x", [], _poi("Huế")), ("a", "6", "pho", "x", [], _poi(None) or (None,) * 13),
        ("b", "7", "pho hue", "x", [], None), ("b", "8", "pho", "x", [], _poi("Huế")), ("c", "9", "pho hue", "x", [], None), ("a", "10", "ha noi", None, None, None),
    ]
    cands = spark.createDataFrame(rows, f"request_id string, id string, text string, reason string, matched array<string>, poi {POI}")
    requests = spark.createDataFrame([("a", "Hà Nội"), ("b", None), ("c", "")], "request_id string, city string")
    aliases = spark.createDataFrame([("ha noi", "ha noi"), ("hue", "hue"), ("da nang", "da nang")], "alias string, city_key string")
    kept = filter_city(cands, requests, aliases)
    assert sorted(int(r.id) for r in kept.collect()) == [1, 4, 7, 8, 9, 10]
    assert kept.columns[0] == "request_id" and set(kept.columns) == set(cands.columns)
    # places and requests without a city have no text to compare: they must not meet the named cities on a null key
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join LeftOuter" in line and "said" in line]
    assert len(joined) == 1 and "poi" not in joined[0]
    assert "Union" in plan


def test_direct_evidence_meets_the_query_once_for_candidates_that_differ_in_place(spark):
    rows = [("r", "autocomplete", 1, i, "Category Search", ["Quán phở"], 0.9 + (i % 3) / 100, None) for i in range(300)]
    rows += [("r", "autocomplete", 101, 2, "Brand Search", ["pho"], 0.92, 0.0), ("r", "autocomplete", 1, 7, "Brand Search", ["pho"], 0.92, None), ("r", "poi", 2, 1, "Attribute Search", ["pho"], 2.0, 0.5)]
    cands = spark.createDataFrame(rows, "request_id string, source string, src_ord int, row_ord long, type string, matched array<string>, base double, boost double")
    requests = spark.createDataFrame([("r", "pho", "pho", "quan pho")], "request_id string, q string, norm string, expanded string")
    found = direct_evidence_intent(cands, requests)
    # both are equal to a form: 0.92 + 0.5 + 0.18 each, and the smaller place decides
    assert [tuple(r) for r in found.collect()] == [("r", "Category Search", 0.76)]
    left = found._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in left.splitlines() if "Aggregate [request_id" in line and "matched" in line and "plain" in line]
    assert grouped
    assert cands.filter(F.col("source") == "autocomplete").count() == 302

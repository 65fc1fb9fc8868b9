"""Truth rows of the column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from prefixlake.functions import geo, match, num, text
from prefixlake.operators import blocking
from prefixlake.operators.understand import expand_queries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalization(spark):
    assert one(spark, text.strip_accents(F.lit("Đà Nẵng Nguyễn Huệ"))) == "Da Nang Nguyen Hue"
    assert one(spark, text.normalize_text(F.lit("  Cà   phê---gần đây  "))) == "ca phe gan day"
    assert one(spark, text.normalize_text(F.lit("Quán Cà-Phê 24/7, Đà Nẵng (TP.HCM)!"))) == "quan ca phe 24 7 da nang tp.hcm"
    assert one(spark, text.tokenize(F.lit("TP.HCM q1"))) == ["tp", "hcm", "q1"]
    assert one(spark, text.phrase_tokens(F.lit("TP.HCM q1"))) == ["tp.hcm", "q1"]


def test_token_phrases(spark):
    swap = lambda t, p, r: one(spark, text.replace_token_phrase(F.lit(t), F.lit(p), F.lit(r)))
    assert swap("q q quan q", "q", "quan") == "quan quan quan quan"
    assert swap("a a a", "a a", "b") == "b a"
    assert not one(spark, text.contains_token_phrase(F.lit("quan cafe"), F.lit("caf")))


def test_expansion(spark, mini):
    rows = spark.createDataFrame([("nguyen huee",), ("ks d",)], "q string")
    out = {r["q"]: r["expanded"] for r in expand_queries(rows, mini.abbreviations).collect()}
    assert out["nguyen huee"] == "nguyen hue"
    assert out["ks d"].startswith("khach san")


def test_rounding_and_hours(spark):
    assert one(spark, num.round3(F.lit(0.5005))) == pytest.approx(0.5)
    inside = lambda h, m: one(spark, geo.within_hours(F.lit(h), F.lit(m)))
    assert inside("22:00-06:00", 1400) and inside("22:00-06:00", 100) and not inside("22:00-06:00", 700)
    assert not inside("07:00-22:00", 1320) and inside("07:00-24:00", 1439) and not inside("always", 5)


def test_semantic_evidence(spark):
    strong = lambda q, d: one(spark, match.strong_semantic_evidence(F.lit(q), F.lit(d)))
    assert not strong("ca phe gan day", "benh vien bach mai ha noi")
    assert strong("ca phe gan day", "quan ca phe gan day")


def _strings(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    bits = ["ca", "phe", "quan", "q", "an", "benh", "vien", "vienn", "24", "7", "tp.hcm", "ganday", "gan", "day", "cafe", "khachsan", "khach", "san"]
    return sorted({" ".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(n)})


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_blocked_match_equals_brute_force(spark, hot_rows):
    values = spark.createDataFrame([(v,) for v in _strings(1, 120)], "h string")
    queries = spark.createDataFrame([(v,) for v in _strings(2, 60)], "norm string").select(
        "norm", F.replace("norm", F.lit("cafe"), F.lit("ca phe")).alias("expanded")
    ).withColumn("tokens", text.dot_words(F.col("expanded")))
    got = blocking.match_values(queries, values, hot_rows).filter("full").select("norm", "expanded", "h")
    want = queries.crossJoin(values).filter(
        match.query_matches(F.col("h"), F.col("norm"), F.col("expanded"), F.col("tokens"))
    ).select("norm", "expanded", "h")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) > 100


def test_blocked_triggers_equal_brute_force(spark):
    triggers = spark.createDataFrame([(v,) for v in _strings(3, 120)], "trigger string")
    queries = spark.createDataFrame([(f"{v} {v}",) for v in _strings(4, 60)], "query string")
    got = blocking.fire_triggers(queries, triggers, 5)
    want = queries.crossJoin(triggers).filter(match.template_match(F.col("query"), F.col("trigger")))
    rows = lambda df: sorted((r["query"], r["trigger"]) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) > 100


def test_list_cells(spark):
    from prefixlake.sources.readers import split_list

    assert one(spark, split_list(F.lit(" wifi ; yên tĩnh;; "))) == ["wifi", "yên tĩnh"]

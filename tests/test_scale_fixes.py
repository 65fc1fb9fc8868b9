"""Cases that once were cut off, tied or crashed."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from prefixlake.operators import entities, places
from prefixlake.operators.cities import city_mentions
from prefixlake.operators.patterns import generated_corpus
from prefixlake.operators.understand import expand_queries
from prefixlake.session import work_folder
from prefixlake.sources import readers
from prefixlake.streaming.events import live_profiles


def test_a_city_of_nine_words_is_found(spark):
    name = "city of the nine long words by the sea"
    aliases = spark.createDataFrame([(name, "nine"), ("ha noi", "hn"), ("ha", "x")], "alias string, city_key string")
    texts = spark.createDataFrame([(f"hotel in {name} please",), ("near ha noi",), ("hanoi",), ("",)], "text string")
    assert sorted(map(tuple, city_mentions(texts, aliases).collect())) == [(f"hotel in {name} please", "nine"), ("near ha noi", "hn"), ("near ha noi", "x")]


def test_many_abbreviations_and_their_order(spark):
    filler = spark.range(50_000).select(F.concat(F.lit("zz"), F.col("id")).alias("abbreviation"), F.concat(F.lit("expanded "), F.col("id")).alias("expanded_form"), F.lit("t").alias("type"), (F.col("id") + 100).alias("row_ord"))
    rules = spark.createDataFrame(
        [("qq", "first", "t", 0), ("ww", "second", "t", 1), ("ww", "never", "t", 2), ("aa bb", "cc", "t", 3), ("dd", "aa", "t", 4), ("cc", "last", "t", 5)],
        "abbreviation string, expanded_form string, type string, row_ord long",
    )
    asked = spark.createDataFrame([("qq ww",), ("zz7 zz49999 x",), ("aa bb",), ("dd bb",), ("nothing here",)], "q string")
    got = {r["q"]: (r["expanded"], r["expansions"]) for r in expand_queries(asked, filler.union(rules)).collect()}
    assert got["qq ww"] == ("first second", ["qq -> first", "ww -> second"])
    assert got["zz7 zz49999 x"][0] == "expanded 7 expanded 49999 x"
    assert got["aa bb"] == ("last", ["aa bb -> cc", "cc -> last"])  # a rule brings up the next
    assert got["dd bb"][0] == "aa bb"  # the longer rule had its turn before
    assert got["nothing here"] == ("nothing here", [])


def test_abbreviations_as_read_keep_file_order(spark):
    path = work_folder(spark, "abbr")
    rows = [("ab", f"form {i}", "t") for i in range(8)] + [(x, f"{x} long", "t") for x in ("qa", "qb", "qc", "qd", "qe", "qf")]
    spark.createDataFrame(rows, "abbreviation string, expanded_form string, type string").coalesce(1).write.option("header", True).csv(path)
    read = readers.read_abbreviations(spark, path)
    assert [r["expanded_form"] for r in read.orderBy("row_ord").collect()] == [r[1] for r in rows]
    asked = spark.createDataFrame([("ab qa qf",)], "q string")
    assert expand_queries(asked, read).first()["expanded"] == "form 0 qa long qf long"


def test_generated_phrases_have_their_own_ordinals(mini):
    rows = generated_corpus(mini)
    assert rows.count() == rows.select("row_ord").distinct().count() > 100


PLACE = "poi_id string, poi_name string, address string, city string, category string, brand string, latitude double, longitude double, popularity_score long"


def test_geocode_finds_one_letter_texts(spark):
    pois = spark.createDataFrame([("p1", "K", "1 b street", "x", "c", "", 10.0, 100.0, 5), ("p2", "Other", "2 d road", "y", "c", "", 10.0, 100.0, 9)], PLACE)
    asked = spark.createDataFrame([(1, "k"), (2, "1 b"), (3, "z")], "request_id long, address string")
    assert sorted((r["request_id"], r["poi_id"], r["score"]) for r in places.geocode(asked, pois).collect()) == [(1, "p1", 1.0), (2, "p1", 1.0)]


def test_merge_keeps_the_better_row(spark):
    kind = "request_id long, id string, name string, score double, lat double, lon double, ord long"
    first = spark.createDataFrame([(1, "a", "old", 0.4, 10.0, 100.0, 1), (1, "b", "old", 0.9, None, None, 2), (1, "c", "old", 0.9, 1.0, 1.0, 3)], kind)
    second = spark.createDataFrame([(1, "a", "new", 0.8, None, None, 1), (1, "b", "new", 0.2, 5.0, 5.0, 2), (1, "c", "new", 0.9, 2.0, 2.0, 3), (1, "d", "new", None, None, None, 4)], kind)
    got = {r["id"]: (r["name"], r["score"]) for r in places.merge_places(first, second).collect()}
    assert got == {"a": ("new", 0.8), "b": ("new", 0.9), "c": ("old", 0.9), "d": ("new", None)}


def test_reverse_geocode_with_fewer_places_than_asked(spark):
    pois = spark.createDataFrame([("p1", 10.0, 100.0, 1), ("p2", -40.0, -70.0, 2)], "poi_id string, latitude double, longitude double, popularity_score long")
    asked = spark.createDataFrame([(1, 10.0, 100.0), (2, 10.0, 100.0), (3, -40.0, -70.1)], "request_id long, lat double, lon double")
    got = sorted((r["request_id"], r["rank"], r["poi_id"]) for r in places.reverse_geocode(asked, pois, 5).collect())
    assert got == [(1, 1, "p1"), (1, 2, "p2"), (2, 1, "p1"), (2, 2, "p2"), (3, 1, "p2"), (3, 2, "p1")]


def test_live_profiles_with_a_late_batch(spark):
    folder, mark, out = (work_folder(spark, n) for n in ("in", "mark", "out"))
    kind = "user_id string, query string, selected_text string, selected_type string, brand string, category string, city string, occurred_at timestamp, ingest_seq long"

    def event(seq: int, text: str) -> tuple:
        from datetime import datetime

        return ("u", text, None, None, None, None, None, datetime(2024, 1, 1), seq)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in ([event(10, "alpha")], [event(20, "bravo")], [event(5, "alpha"), event(6, "charlie")]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kind).parquet(folder)

        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        live_profiles(stream, 1_704_067_200_000_000).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    newest = rows.groupBy("user_key").agg(F.max("version").alias("version"))
    got = sorted((r["term"], round(r["weight"], 6)) for r in rows.join(newest, ["user_key", "version"]).collect())
    assert got == [("alpha", 2.0), ("bravo", 1.0), ("charlie", 1.0)]


def test_later_place_names_meet_only_queries_that_have_too_few(spark, monkeypatch):
    """Names of the first rows meet all queries; the entities are those of a join with all names, streets and brands."""
    kinds = [("Quán cà phê", "Cafe"), ("ATM", "ATM"), ("Chợ", "Chợ")]
    pois = [(f"P{i}", f"{kinds[i % 3][1]} {'Nguyễn Huệ' if i % 2 else 'Lê Lợi'} {i}", kinds[i % 3][0], "Vinmart" if i == 55 else "", f"{i} Trần Phú, Huế", "Huế", i) for i in range(60)]
    pois.append(("P60", "Sân bay Phú Bài", "Sân bay", "", "1 Bạch Đằng, Huế", "Huế", 60))
    table = spark.createDataFrame(pois, "poi_id string, poi_name string, category string, brand string, address string, city string, row_ord bigint")
    catalog = SimpleNamespace(pois=table)
    asked = ["atm", "cafe", "cho", "san bay", "vinm", "vinmart", "bach dang", "nguyen hue", "zzz"]
    forms = spark.createDataFrame([(q, q, q, q.split(), []) for q in asked], "q string, norm string, expanded string, tokens array<string>, expansions array<string>")
    rows = lambda: sorted(map(tuple, entities.extract_entities(forms, catalog, 3).collect()))
    want, met, fire = rows(), [], entities.fire_triggers

    def counted(queries, triggers, *rest):
        met.append(({r[0] for r in queries.select("query").collect()}, triggers.select("trigger").distinct().count()))
        return fire(queries, triggers, *rest)

    monkeypatch.setattr(entities, "fire_triggers", counted)
    monkeypatch.setattr(entities, "FIRST_NAMES", 12)
    assert rows() == want and {"san bay", "vinmart"} <= {r[0] for r in want}
    assert len(met) == 2 and len(met[0][0]) == len(asked) and met[1][0] < met[0][0]
    assert not any("atm" in q or "cafe" in q for q in met[1][0]) and any("san bay" in q for q in met[1][0])


def test_points_and_places_of_one_spot_are_paired_once(spark, monkeypatch):
    """40 requests a point and 50 places a spot: pairs grow with points and spots; ranks are those of all pairs."""
    spots = [(10.0 + i / 100, 106.0 + j / 100) for i in range(3) for j in range(2)]
    pois = [(f"P{i:03}", *spots[i % 6], i % 7 if i % 11 else None) for i in range(300)]
    asked = [(i, *spots[i % 5]) for i in range(200)] + [(0, *spots[1]), (7, *spots[2]), (900, None, 106.0), (901, 60.0, 10.0)]
    places_ = spark.createDataFrame(pois, "poi_id string, latitude double, longitude double, popularity_score int")
    requests = spark.createDataFrame(asked, "request_id int, lat double, lon double")
    met, pairs = [], places.range_pairs

    def counted(left, right, *rest):
        met.append((left.count(), right.count()))
        return pairs(left, right, *rest)

    monkeypatch.setattr(places, "range_pairs", counted)
    got = sorted(map(tuple, places.nearby(requests, places_, 1500.0, None, 4).collect()))
    whole = pairs(requests, places_, 1500.5).withColumn("distance_m", places.half_up(F.col("distance")).cast("bigint")).filter("distance_m <= 1500")
    want = sorted(map(tuple, places._first(whole, 4).select("request_id", "poi_id", "distance_m", "rank").collect()))
    assert got == want and len(got) == 200 * 4
    assert met == [(7, 24)]

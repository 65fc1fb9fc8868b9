"""City spellings: canonical keys, mentions, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.text import contains_token_phrase, let, normalize_text, plain, words
from prefixlake.rules import CITY_ALIASES, KNOWN_CITIES
from prefixlake.session import few
from prefixlake.sources.catalog import Catalog


def city_key(norm: Column) -> Column:
    """Canonical key of a normalized city name: its alias group, else the name itself."""
    out = F.when(F.lit(False), norm)
    for key, aliases in CITY_ALIASES.items():
        out = out.when(norm.isin(aliases), F.lit(key))
    return out.otherwise(norm)


def behavior_city_key(norm: Column) -> Column:
    """As :func:`city_key`, and any name that contains the big southern city's name."""
    return F.when(contains_token_phrase(norm, F.lit("ho chi minh")), F.lit("tp.hcm")).otherwise(city_key(norm))


def with_city_key(df: DataFrame, col: str, out: str = "city_key") -> DataFrame:
    return df.withColumn(out, city_key(normalize_text(F.col(col))))


def mention_aliases(catalog: Catalog) -> DataFrame:
    """(alias, city_key) of every known city, spellings of three letters or more."""
    fixed = [(a, k) for k, aliases in CITY_ALIASES.items() for a in aliases if plain(k) in [plain(c) for c in KNOWN_CITIES]]
    known = catalog.spark.createDataFrame(fixed, "alias string, city_key string")
    seen = catalog.pois.filter("city <> ''").select(normalize_text(F.col("city")).alias("alias")).distinct()
    return (
        known.unionByName(seen.select("alias", city_key(F.col("alias")).alias("city_key")))
        .filter("length(alias) >= 3").distinct()
    )


def city_mentions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(text, city_key) for every city a normalized text names as a whole phrase.

    Texts meet aliases on the alias's first word; the phrase itself is then checked, however
    many words it has.
    """
    distinct = texts.select("text").filter("text <> ''").distinct()
    starts = distinct.select("text", F.explode(F.array_distinct(words(F.col("text")))).alias("first"))
    named = aliases.withColumn("first", F.element_at(words(F.col("alias")), 1))
    return starts.join(named, "first").filter(contains_token_phrase(F.col("text"), F.col("alias"))).select("text", "city_key").distinct()


def name_cities(cands: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``named``, the cities a candidate without a place names; each wording is read once."""
    said = F.when(F.col("poi").isNull(), F.concat_ws(" ", "text", "reason", F.array_join("matched", " ")))
    rows = cands.withColumn("said", said)
    texts = rows.select("said").filter("said is not null").distinct().withColumn("text", normalize_text(F.col("said")))
    cities = texts.join(city_mentions(texts, aliases), "text").groupBy("said").agg(F.collect_set("city_key").alias("named"))
    # places name none: they would share a null key, and so a task
    told = rows.filter("said is not null").join(cities, "said", "left")
    return told.unionByName(rows.filter("said is null").withColumn("named", F.lit(None).cast("array<string>"))).drop("said")


def filter_city(cands: DataFrame, requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keep candidates that fit the request's city.

    Places must lie in it; other candidates must not name a different known city. Those whose
    cities are ``named`` already are not read again.
    """
    wanted = requests.filter("coalesce(city, '') <> ''").select("request_id", city_key(normalize_text(F.col("city"))).alias("want"))
    rows, columns = cands.join(few(wanted) if "named" in cands.columns else wanted, "request_id", "left"), ["request_id", *(c for c in cands.columns if c not in ("request_id", "named"))]
    free, placed = F.col("want").isNull(), F.col("poi").isNotNull()
    if "named" in cands.columns:
        there = let(normalize_text(F.col("poi.city")), city_key).eqNullSafe(F.col("want"))
        return rows.filter(free | F.when(placed, there).otherwise(F.col("named").isNull() | ~F.exists("named", lambda c: c != F.col("want")))).select(*columns)
    # only texts that may be dropped meet the cities they name: rows without one would share a null key, and so a task
    said = F.concat_ws(" ", "text", "reason", F.array_join("matched", " "))
    told = rows.filter(~free & ~placed).withColumn("said", said)
    texts = told.select("said").distinct().withColumn("text", normalize_text(F.col("said")))
    cities = texts.join(city_mentions(texts, aliases), "text").groupBy("said").agg(F.collect_set("city_key").alias("named"))
    other = F.col("named").isNull() | ~F.exists("named", lambda c: c != F.col("want"))
    near = rows.filter(free | (placed & let(normalize_text(F.col("poi.city")), city_key).eqNullSafe(F.col("want"))))
    return near.select(*columns).unionByName(told.join(cities, "said", "left").filter(other).select(*columns))

"""Score factors, weights, merging and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefixlake.functions.geo import clock_minutes, distance_label, distance_locality, haversine_m, valid_point, within_hours
from prefixlake.functions.num import clamp01, round3
from prefixlake.functions.text import has_any, normalize_text, padded, quoted
from prefixlake.operators.cities import city_key
from prefixlake.operators.enrich import first_by_key
from prefixlake.rules import FACTOR_LABELS, FACTORS, LEARNED_WEIGHTS, SOURCES

FACTOR_STRUCT = "struct<" + ",".join(f"{f}:double" for f in FACTORS) + ">"


def _by_source(source: Column, slot: int) -> Column:
    show = lambda v: quoted(v) if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)
    return F.element_at(F.expr("map(" + ", ".join(f"{quoted(s)}, {show(row[slot])}" for s, row in SOURCES.items()) + ")"), source)


def locality_context(cands: DataFrame, requests: DataFrame) -> DataFrame:
    """Add ``locality`` and ``context`` (reasons) from distance, city and time of day."""
    context = requests.select("request_id", "city", "lat", "lon", "now")
    df = cands.join(context, "request_id")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & valid_point(F.col("lat"), F.col("lon"))
    has_poi, in_city = F.col("poi").isNotNull(), F.coalesce("city", F.lit("")) != ""
    meters = F.when(located & has_poi, haversine_m(F.col("lat"), F.col("lon"), F.col("poi.lat"), F.col("poi.lon")))
    same = in_city & has_poi & (city_key(normalize_text(F.col("poi.city"))) == city_key(normalize_text(F.col("city"))))
    base = (
        F.when(F.col("meters").isNotNull(), distance_locality(F.col("meters")))
        .when(same, 1.0).when(located, 0.72).when(in_city, 0.45).otherwise(0.7)
    )
    minutes = F.when(F.coalesce("now", F.lit("")) != "", clock_minutes(F.col("now")))
    hay = normalize_text(
        F.concat_ws(
            " ", "text", "type", F.coalesce("poi.category", F.lit("")), F.coalesce("poi.brand", F.lit("")),
            F.array_join(F.coalesce("poi.tags", F.array().cast("array<string>")), " "),
        )
    )
    option = lambda score, prio, reason: F.struct(score.alias("score"), F.lit(prio).alias("priority"), reason.alias("reason"))
    is_open = has_poi & within_hours(F.col("poi.hours"), F.col("minutes"))
    open_now = F.when(
        is_open,
        option(
            F.when(F.col("poi.hours") == "00:00-24:00", 1.0).otherwise(0.88), 1,
            F.concat(F.lit("open at request time from enrichment hours ("), F.col("poi.hours"), F.lit(")")),
        ),
    )
    night = (F.col("minutes") >= 1260) | (F.col("minutes") < 300)
    late = F.when(
        night & has_any(F.col("hay"), ["24 7", "24h", "mo cua khuya", "an dem", "khuya"]),
        option(F.when(has_any(F.col("hay"), ["24 7", "24h"]), 1.0).otherwise(0.96), 3, F.lit("night context favors 24/7/open-late result")),
    )
    morning = (F.col("minutes") >= 300) & (F.col("minutes") < 600)
    pho = F.contains(padded(F.col("hay")), F.lit(" pho ")) | has_any(F.col("hay"), ["bua sang", "an sang", "breakfast"])
    early = F.when(morning & pho, option(F.lit(0.96), 3, F.lit("morning context favors breakfast/phở result")))
    out = (
        df.withColumn("meters", meters).withColumn("place_score", base).withColumn("minutes", minutes)
        .withColumn("hay", F.when(F.col("minutes").isNotNull(), hay))
        .withColumn("moment", F.greatest(open_now, late, early))
    )
    distance_note = F.when(F.col("meters").isNotNull(), F.concat(F.lit("current-location distance "), distance_label(F.col("meters"))))
    return out.withColumn(
        "locality", round3(clamp01(F.greatest("place_score", F.coalesce("moment.score", F.lit(0.0)))))
    ).withColumn("context", F.array_compact(F.array(distance_note, F.col("moment.reason")))).drop(
        "meters", "place_score", "minutes", "hay", "moment", "city", "lat", "lon", "now"
    )


def resolve_weights(requests: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Add ``weights``: request weights over the defaults, floored, clamped and normalized.

    The optional column ``ranking_weights`` (struct of factors) holds a request's own weights;
    locality floors for located or timed requests apply only where it is null.
    """
    defaults = defaults or LEARNED_WEIGHTS
    own = "ranking_weights" in requests.columns
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & valid_point(F.col("lat"), F.col("lon"))
    timed = F.when(F.coalesce("now", F.lit("")) != "", clock_minutes(F.col("now"))).isNotNull()
    floor = F.when(located, 0.16).when(timed, 0.1).otherwise(0.0)
    if own:
        floor = F.when(F.col("ranking_weights").isNull(), floor).otherwise(0.0)
    value = {}
    for name in FACTORS:
        base = F.lit(float(defaults[name]))
        if own:
            base = F.coalesce(F.col(f"ranking_weights.{name}"), base)
        value[name] = F.when(F.isnan(base), 0.0).otherwise(F.greatest(F.lit(0.0), base))
    value["locality"] = F.greatest(value["locality"], floor)
    raw = requests.withColumn("raw_weights", F.struct(*[v.alias(n) for n, v in value.items()]))
    total = sum((F.col(f"raw_weights.{n}") for n in FACTORS[1:]), F.col(f"raw_weights.{FACTORS[0]}"))
    share = lambda n: F.when(total > 0, F.col(f"raw_weights.{n}") / total).otherwise(F.lit(float(defaults[n])))
    return raw.withColumn("weights", F.struct(*[share(n).alias(n) for n in FACTORS])).drop("raw_weights")


def score_factors(cands: DataFrame) -> DataFrame:
    """Add ``factors`` from base, boost, intent_type, freq, poi, locality and personal boost."""
    boosted = F.col("base") + F.coalesce("boost", F.lit(0.0))
    lexical = F.when(F.coalesce("boost", F.lit(0.0)) != 0, F.least(F.lit(1.18), boosted)).otherwise(F.col("base"))
    return cands.withColumn(
        "factors",
        F.struct(
            lexical.alias("lexical"), F.when(F.col("type") == F.col("intent_type"), 1.0).otherwise(0.55).alias("intent"),
            _by_source(F.col("source"), 0).alias("source"), clamp01(F.col("freq")).alias("popularity"),
            F.coalesce("poi.quality", F.lit(0.68)).alias("poiQuality"), F.col("locality").alias("locality"),
            clamp01(F.coalesce("personal_boost", F.lit(0.0))).alias("personalization"), _by_source(F.col("source"), 1).alias("diversity"),
        ).cast(FACTOR_STRUCT),
    )


def weighted_score(factors: str = "factors", weights: str = "weights") -> Column:
    """Dot product of the eight factors and weights, three decimals."""
    total = F.col(f"{factors}.{FACTORS[0]}") * F.col(f"{weights}.{FACTORS[0]}")
    for name in FACTORS[1:]:
        total = total + F.col(f"{factors}.{name}") * F.col(f"{weights}.{name}")
    return round3(total)


def dedupe_text(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per request and normalized text: the higher score, first seen on ties.

    ``first_seen`` is the place of the text's first appearance, which breaks later ties.
    A partial aggregation does the work before the shuffle.
    """
    columns = keep or [c for c in df.columns if c not in ("request_id", "norm_text")]
    place = F.struct("src_ord", "row_ord")
    return (
        df.groupBy("request_id", "norm_text")
        .agg(F.min_by(F.struct(*columns), F.struct((-F.col("score")).alias("n"), place.alias("p"))).alias("w"), F.min(place).alias("first_seen"))
        .select("request_id", "norm_text", "w.*", "first_seen")
    )


def clamp_limit(limit: Column) -> Column:
    return F.least(F.lit(12), F.greatest(F.lit(1), F.floor(F.coalesce(limit, F.lit(8)) + 0.5))).cast("int")


def top_k(df: DataFrame, limit: Column | int = 8) -> DataFrame:
    """The best rows per request with a rank penalty; limits are clamped to 1..12."""
    wanted = clamp_limit(F.lit(limit) if isinstance(limit, int) else limit)
    order = W.partitionBy("request_id").orderBy(F.desc("score"), _by_source(F.col("source"), 2), "first_seen")
    ranked = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 12).filter(F.col("rank") <= wanted)
    return ranked.withColumn("score", round3(F.greatest(F.lit(0.01), F.col("score") - (F.col("rank") - 1) * 0.005)))


def top_factors(factors: Column, n: int = 3) -> Column:
    """The ``n`` largest positive factors as (key, value), by value then name."""
    listed = F.array(*[F.struct((-factors[f]).alias("n"), F.lit(f).alias("key"), factors[f].alias("value")) for f in FACTORS])
    return F.slice(F.array_sort(F.filter(listed, lambda x: x["value"] > 0)), 1, n)


def explain(df: DataFrame) -> DataFrame:
    """Add ``evidence`` lines and a ``summary`` sentence to ranked suggestions."""
    label = _by_source(F.col("source"), 3)
    names = F.create_map(*[F.lit(x) for kv in FACTOR_LABELS.items() for x in kv])
    top = top_factors(F.col("factors"))
    shown = F.slice(F.filter("matched", lambda m: m != ""), 1, 3)
    line = lambda prefix, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), value))
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    personal = has("personal_reason")
    percent = F.transform(
        top, lambda x: F.concat(F.element_at(names, x["key"]), F.lit(" "), F.floor(x["value"] * 100 + 0.5).cast("bigint").cast("string"), F.lit("%"))
    )
    evidence = F.array_compact(
        F.array(
            F.concat(F.lit("Source: "), label), line("Matched query evidence: ", F.array_join(shown, ", ")),
            F.concat(F.lit("Ranking reason: "), "reason"), line("Brand: ", F.col("poi.brand")), line("Category: ", F.col("poi.category")),
            line("City: ", F.col("poi.city")), line("Address: ", F.col("poi.address")), line("Personalization: ", personal),
            line("Enrichment: ", F.array_join(has_array(df, "enriched"), ", ")), line("Top score factors: ", F.array_join(percent, ", ")),
        )
    )
    unique = first_by_key(evidence, normalize_text)
    signals = F.array_join(F.transform(top, lambda x: F.element_at(names, x["key"])), ", ")
    summary = F.concat(
        F.concat_ws(
            ", ", F.concat(F.col("text"), F.lit(" is ranked from "), label), line("matching ", F.array_join(F.slice(shown, 1, 2), ", ")),
            F.concat(F.lit("as "), F.col("type")), line("with strongest signals from ", signals),
            F.when(F.coalesce(personal, F.lit("")) != "", F.lit("and local profile evidence")),
        ), F.lit("."),
    )
    return df.withColumn("evidence", F.slice(unique, 1, 10)).withColumn("summary", summary)


def has_array(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.array().cast("array<string>")



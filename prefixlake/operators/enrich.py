"""Place enrichment: provenance, opening hours, summaries, attributes, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.match import equivalent_list, equivalent_number, equivalent_text
from prefixlake.functions.num import half_up, round3
from prefixlake.functions.text import has_any, let, lit_map, normalize_text
from prefixlake.rules import CATEGORY_LABELS, EVIDENCE_PRIORITY, HOURS_DEFAULT, HOURS_RULES, TAG_LABELS

ATTRIBUTE = "struct<key:string,label:string,value:string,source:string,confidence:double,evidence:array<string>>"


def first_by_key(items: Column, key) -> Column:
    """Items whose key did not occur before, order kept."""
    def body(v: Column) -> Column:
        return F.filter(v["items"], lambda x, i: F.array_position(v["keys"], key(x)) == i + 1)

    return let(
        items, lambda xs: let(F.struct(xs.alias("items"), F.transform(xs, key).alias("keys")), body)
    )


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map(table), key), default)


def format_number(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", c))


def format_integer(c: Column) -> Column:
    """Whole number with dots between thousands."""
    return F.translate(F.format_number(half_up(c.cast("double")).cast("bigint"), 0), ",", ".")


def hours_of(category: Column, tags: Column) -> Column:
    """struct(value, confidence): opening hours guessed from category and tags."""
    text = normalize_text(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.array_join(tags, " ")))
    make = lambda hours, conf: F.struct(F.lit(hours).alias("value"), F.lit(conf).alias("confidence"))
    out = F.when(F.lit(False), make(*HOURS_DEFAULT))
    for needles, hours, conf in HOURS_RULES:
        out = out.when(has_any(text, needles), make(hours, conf))
    return out.otherwise(make(*HOURS_DEFAULT))


def attributes_of(category: Column, tags: Column, rating: Column, reviews: Column, popularity: Column) -> Column:
    """All evidence-backed attributes of a place, unique by key, in a fixed order."""
    def attribute(key: Column, label: Column, value: Column, source: str, conf: float, evidence: Column) -> Column:
        return F.struct(
            key.alias("key"), label.alias("label"), value.alias("value"), F.lit(source).alias("source"),
            F.lit(conf).alias("confidence"), F.array(evidence).alias("evidence"),
        )

    cat_key = normalize_text(F.coalesce(category, F.lit("")))
    from_category = F.when(
        cat_key != "",
        attribute(
            F.concat(F.lit("category:"), F.replace(cat_key, F.lit(" "), F.lit("-"))),
            _lookup(CATEGORY_LABELS, cat_key, category), category, "provided-dataset", 0.86,
            F.concat(F.lit("category="), category),
        ),
    )
    from_tags = F.transform(
        tags,
        lambda t: attribute(
            F.concat(F.lit("tag:"), F.regexp_replace(normalize_text(t), "[^a-z0-9]+", "-")),
            _lookup(TAG_LABELS, normalize_text(t), t), t, "provided-dataset", 0.84, F.concat(F.lit("tag="), t),
        ),
    )
    derived = lambda key, label, value, conf, evidence: attribute(
        F.lit(key), F.lit(label), value.cast("string"), "local-derived", conf, evidence
    )
    rating_note = F.concat(F.lit("rating="), format_number(rating))
    review_note = F.concat(F.lit("review_count="), format_integer(reviews))
    popular_note = F.concat(F.lit("popularity_score="), format_integer(popularity))
    from_rating = F.when(
        rating >= 4.5, derived("quality:high-rating", "Đánh giá rất tốt", rating, 0.82, rating_note)
    ).when(rating >= 4, derived("quality:good-rating", "Đánh giá tốt", rating, 0.78, rating_note))
    from_reviews = F.when(
        reviews >= 1000, derived("quality:many-reviews", "Nhiều lượt đánh giá", reviews, 0.8, review_note)
    )
    from_popularity = F.when(
        popularity >= 90, derived("popularity:very-high", "Rất phổ biến", popularity, 0.83, popular_note)
    ).when(popularity >= 75, derived("popularity:high", "Phổ biến", popularity, 0.77, popular_note))
    listed = F.array_compact(
        F.concat(
            F.array(from_category), F.coalesce(from_tags, F.array().cast(f"array<{ATTRIBUTE}>")),
            F.array(from_rating, from_reviews, from_popularity),
        )
    )
    return first_by_key(listed, lambda x: x["key"])


def top_evidence(attributes: Column, n: int = 6) -> Column:
    """Attributes by priority group, then confidence, first-seen on ties; at most ``n``."""
    def group(key: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0))
        for rank, start in enumerate(EVIDENCE_PRIORITY):
            out = out.when(F.startswith(key, F.lit(start)), F.lit(rank))
        return out.otherwise(F.lit(len(EVIDENCE_PRIORITY)))

    keyed = F.transform(
        attributes,
        lambda a, i: F.struct(group(a["key"]).alias("g"), (-a["confidence"]).alias("c"), i.alias("i"), a.alias("a")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["a"])


def poi_attributes(df: DataFrame) -> Column:
    return attributes_of(
        F.col("category"), F.col("tags"), F.col("rating"), F.col("review_count"), F.col("popularity_score")
    )


def opening_hours(pois: DataFrame) -> DataFrame:
    return pois.withColumn("h", hours_of(F.col("category"), F.col("tags"))).select(
        "poi_id", F.col("h.value").alias("hours"), F.col("h.confidence").alias("confidence")
    )


def derive_attributes(pois: DataFrame) -> DataFrame:
    """One row per place and attribute, in order."""
    return pois.select("poi_id", F.posexplode(poi_attributes(pois)).alias("ord", "a")).select("poi_id", "ord", "a.*")


def ranking_evidence(pois: DataFrame, n: int = 6) -> DataFrame:
    return pois.select(
        "poi_id", F.posexplode(top_evidence(poi_attributes(pois), n)).alias("ord", "a")
    ).select("poi_id", "ord", "a.*")


def summary_fields(pois: DataFrame) -> Column:
    """Names of the fields a summary can rest on."""
    named = lambda name, present: F.when(F.coalesce(present, F.lit(False)), F.lit(name))
    return F.array_compact(
        F.array(
            named("label", F.col("poi_name") != ""), named("category", F.col("category") != ""),
            named("address", F.col("address") != ""), named("rating", F.col("rating").isNotNull()),
            named("reviewCount", F.col("review_count").isNotNull()),
            named("popularityScore", F.col("popularity_score").isNotNull()), named("tags", F.size("tags") > 0),
        )
    )


def summary_evidence(pois: DataFrame) -> DataFrame:
    return pois.select("poi_id", summary_fields(pois).alias("evidence"))


def summary_text(pois: DataFrame) -> Column:
    category = F.coalesce(F.col("category"), F.lit("một địa điểm"))
    lowered = F.concat(F.lower(F.left(category, F.lit(1))), F.substr(category, F.lit(2)))
    head = F.concat(F.col("poi_name"), F.lit(" là "), lowered)
    address = F.when(F.coalesce(F.col("address"), F.lit("")) != "", F.concat(F.lit("tại "), F.col("address")))
    metrics = F.concat_ws(
        ", ",
        F.concat(F.lit("điểm "), format_number(F.col("rating")), F.lit("/5")),
        F.concat(format_integer(F.col("review_count")), F.lit(" lượt đánh giá")),
        F.concat(F.lit("độ phổ biến "), format_integer(F.col("popularity_score")), F.lit("/100")),
    )
    tag_text = F.array_join(F.slice("tags", 1, 4), ", ")
    return F.concat_ws(
        " ",
        F.concat(F.concat_ws(" ", head, address), F.lit(".")),
        F.when(metrics != "", F.concat(F.lit("Dữ liệu hackathon ghi nhận "), metrics, F.lit("."))),
        F.when(tag_text != "", F.concat(F.lit("Thuộc tính nổi bật: "), tag_text, F.lit("."))),
    )


def evidence_summary(pois: DataFrame) -> DataFrame:
    return pois.select("poi_id", summary_text(pois).alias("summary"), F.lit(0.78).alias("confidence"))


def _provenance(source: Column, confidence: Column, evidence: Column, generated: bool, verified: Column, note=None) -> Column:
    return F.struct(
        source.alias("source"), round3(confidence).alias("confidence"), evidence.alias("evidence"),
        F.lit(generated).alias("generated"), verified.alias("verified_real_world"),
        F.lit(note).cast("string").alias("note"),
    )


FIELD_EVIDENCE = [
    ("id", "poi_id", "stable POI identifier"), ("name", "poi_name", "POI name"),
    ("address", "address", "POI address"), ("category", "category", "POI category"),
    ("brand", "brand", "POI brand"), ("coordinates", "latitude", "WGS84 latitude/longitude"),
    ("rating", "rating", "POI rating"), ("reviewCount", "review_count", "POI review_count"),
    ("popularityScore", "popularity_score", "POI popularity_score"), ("tags", "tags", "POI tags"),
    ("openingHours", "opening_hours", "upstream opening hours"), ("aiSummary", "ai_summary", "upstream summary"),
]


def provenance_map(pois: DataFrame, source: str = "provided-dataset") -> Column:
    """Map field -> provenance, for the fields a place really has."""
    live = source == "live-upstream"
    entries = []
    for field, column, evidence in FIELD_EVIDENCE:
        if column not in pois.columns:
            continue
        kind = pois.schema[column].dataType.typeName()
        present = F.col(column).isNotNull()
        if kind == "string":
            present = present & (F.col(column) != "")
        if kind == "array":
            present = present & (F.size(column) > 0)
        proof = _provenance(F.lit(source), F.lit(0.88 if live else 0.86), F.array(F.lit(evidence)), False, F.lit(live))
        entries += [F.lit(field), F.when(present, proof)]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def field_provenance(pois: DataFrame, source: str = "provided-dataset") -> DataFrame:
    return pois.select("poi_id", F.explode(provenance_map(pois, source)).alias("field", "p")).select("poi_id", "field", "p.*")


RECONCILED = ["label", "address", "category", "brand", "rating", "review_count", "popularity_score", "tags"]


def reconcile(local: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Fields on which two sources disagree; the live value wins, both are kept.

    Columns missing on either side are skipped; ``latitude`` and ``longitude`` are compared as
    one pair.
    """
    both = local.alias("a").join(live.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    entries = []
    for field in [*RECONCILED, "opening_hours", "ai_summary"]:
        if field not in local.columns or field not in live.columns:
            continue
        a, b = F.col(f"a.{field}"), F.col(f"b.{field}")
        kind = local.schema[field].dataType.typeName()
        if kind == "array":
            same, show = equivalent_list(a, b), lambda c: F.array_join(c, ";")
        elif kind == "string":
            same, show = equivalent_text(a, b), lambda c: c
        else:
            same, show = equivalent_number(a, b), lambda c: c.cast("string")
        differs = a.isNotNull() & b.isNotNull() & ~same
        entries.append(
            F.when(differs, F.struct(F.lit(field).alias("field"), show(a).alias("local_value"), show(b).alias("live_value")))
        )
    if {"latitude", "longitude"} <= set(local.columns) & set(live.columns):
        point = lambda s: F.concat_ws(",", F.col(f"{s}.latitude"), F.col(f"{s}.longitude"))
        differs = (point("a") != point("b")) & (F.length(point("a")) > 1) & (F.length(point("b")) > 1)
        entries.append(
            F.when(differs, F.struct(F.lit("coordinates").alias("field"), point("a").alias("local_value"), point("b").alias("live_value")))
        )
    return (
        both.select(F.col(f"a.{key}").alias(key), F.explode(F.array_compact(F.array(*entries))).alias("d"))
        .select(key, "d.*", F.lit("live").alias("winner"), F.lit(0.82).alias("confidence"))
    )


def coverage_rows(pois: DataFrame) -> DataFrame:
    fields, attributes = provenance_map(pois), poi_attributes(pois)
    sources = F.array_sort(
        F.array_distinct(
            F.concat(F.transform(attributes, lambda a: a["source"]), F.array(F.lit("provided-dataset"), F.lit("local-derived")))
        )
    )
    return pois.withColumn("h", hours_of(F.col("category"), F.col("tags"))).select(
        "poi_id", F.col("poi_name").alias("label"), (F.size(F.map_keys(fields)) + 2).alias("field_count"),
        F.size(attributes).alias("attribute_count"), (summary_text(pois) != "").alias("has_summary"),
        (F.col("h.value") != "").alias("has_hours"), F.lit(0.78).alias("summary_confidence"),
        F.col("h.confidence").alias("hours_confidence"), sources.alias("sources"),
    )


def enrichment_coverage(pois: DataFrame) -> DataFrame:
    """One row: how far the catalog is enriched."""
    return coverage_rows(pois).agg(
        F.count("*").alias("poi_rows"), F.sum(F.col("has_summary").cast("int")).alias("summary_rows"),
        F.sum(F.col("has_hours").cast("int")).alias("hours_rows"), F.min("attribute_count").alias("min_attributes"),
        round3(F.avg("attribute_count")).alias("avg_attributes"), F.min("summary_confidence").alias("min_summary_confidence"),
        F.min("hours_confidence").alias("min_hours_confidence"),
        F.sum(F.array_contains("sources", "provided-dataset").cast("int")).alias("provided_rows"),
        F.sum(F.array_contains("sources", "local-derived").cast("int")).alias("derived_rows"),
    )


def weakest_places(pois: DataFrame, n: int = 10) -> DataFrame:
    """The report's list of the places with the fewest attributes."""
    return (
        coverage_rows(pois).orderBy("attribute_count", "summary_confidence", "poi_id").limit(n)
        .select("poi_id", "label", "attribute_count", "hours_confidence")
    )


def poi_detail(pois: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """Detail rows; ``hours`` and ``ai_summary`` add their derived section."""
    wanted = {name.strip().lower() for name in include}
    out = pois.select(
        F.concat(F.lit("poi:"), "poi_id").alias("id"), F.col("poi_name").alias("label"), "address", "category",
        F.nullif(F.col("brand"), F.lit("")).alias("brand"), "latitude", "longitude",
        round3(F.col("popularity_score") / 100.0).alias("score"), "tags", "rating", "review_count",
        "popularity_score", provenance_map(pois).alias("fields"), poi_attributes(pois).alias("attributes"),
        summary_fields(pois).alias("summary_evidence"), hours_of(F.col("category"), F.col("tags")).alias("h"),
        summary_text(pois).alias("s"),
    )
    if wanted & {"hours", "opening_hours", "openinghours"}:
        out = out.withColumn("opening_hours", F.col("h.value")).withColumn("hours_confidence", F.col("h.confidence"))
    if "ai_summary" in wanted:
        out = out.withColumn("ai_summary", F.col("s"))
    return out.drop("h", "s")

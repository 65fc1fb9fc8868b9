"""Exact deduplication by deterministic block naming, DataFrame operations only.

Texts (A-Z lower-cased) are cut into fixed-size blocks. The distinct blocks are sorted and
numbered: equal blocks, and only those, get one integer name. Adjacent names are then paired,
the distinct pairs sorted and numbered, and so on, until every document has one name; with its
length in bytes that name is an identity without collisions, since nothing is hashed.

Round 0 names documents by (length, first block, last block). A document that is alone under
that name has its identity already and takes no part in the other rounds; texts of all others
are compared over their whole length.

A text, or a block, that many rows share is a hot key of every join from rows to names. Names of more
than one row in HOT_SHARE (there are at most HOT_SHARE of them) therefore meet their rows by broadcast,
and these rows are salted; all other names have few rows each and are joined by a shuffle.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays,
null ids being the smallest; rows repeated with one id count one by one, and one of them stays;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import stored

BLOCK = 1024
#: A name that more than one row in so many has is hot; there are at most as many hot names as this, of 1,024 bytes at most.
HOT_SHARE, HOT_LEAST = 4096, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text in UTF-8 with A-Z lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER).cast("binary")


def joined(rows: DataFrame, names: DataFrame, keys: list[str], many: str) -> DataFrame:
    """``rows`` with the values of ``names``, a stored table with one row per ``keys``; ``many`` is how many of the rows have it.

    Rows without a name have null values.
    """
    values = [c for c in names.columns if c not in keys and c != many]
    limit = max((names.agg(F.sum(many)).first()[0] or 0) / HOT_SHARE, HOT_LEAST)
    hot = F.col(many) > limit
    found = rows.join(F.broadcast(names.filter(hot).select(*keys, F.struct(*values).alias("__hot"))), keys, "left")
    # hot rows go anywhere; the salt of a name is always 0, but not a constant that would drop out of the key
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) + 1).otherwise(F.lit(0)).cast("long")
    others = names.filter(~hot).select(*keys, F.struct(*values).alias("__cold"), F.when(F.col(many) < 0, 1).otherwise(0).cast("long").alias("__salt"))
    met = found.withColumn("__salt", salt).join(others.hint("merge"), [*keys, "__salt"], "left")
    return met.select(*rows.columns, *[F.coalesce(f"__hot.{v}", f"__cold.{v}").alias(v) for v in values])


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the integer name of ``key``: its number among the distinct values.

    The distinct values are dealt out by their hash and sorted within each partition; the name
    is the partition's number followed by the place in it, fixed by storing the table.
    """
    names = stored(rows.groupBy(*key).agg(F.count("*").alias("__many")).sortWithinPartitions(*key).withColumn("__name", F.monotonically_increasing_id()))
    return joined(rows, names, key, "__many").drop(*key)


def document_names(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(__row, __name) for ``rows`` (__row, __bytes): equal names mean equal bytes among rows of one length."""
    count = F.greatest(F.ceil(F.octet_length("__bytes") / block), F.lit(1)).cast("int")
    blocks = rows.select("__row", count.alias("__n"), F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("__bytes", i * block + 1, F.lit(block)))).alias("__pos", "__block"))
    named = stored(_named(blocks, ["__block"]))
    finished = named.filter("__n = 1").select("__row", "__name")
    open_, longest = named.filter("__n > 1"), named.agg(F.max("__n")).first()[0] or 1
    while longest > 1:
        pairs = open_.groupBy("__row", F.floor(F.col("__pos") / 2).cast("int").alias("__pos"), F.floor((F.col("__n") + 1) / 2).cast("int").alias("__n")).agg(
            F.max(F.when(F.col("__pos") % 2 == 0, F.col("__name"))).alias("__left"), F.coalesce(F.max(F.when(F.col("__pos") % 2 == 1, F.col("__name"))), F.lit(-1)).alias("__right")
        )
        named, longest = stored(_named(pairs, ["__left", "__right"])), (longest + 1) // 2
        finished = finished.unionByName(named.filter("__n = 1").select("__row", "__name"))
        open_ = named.filter("__n > 1")
    return finished


def exact_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id", block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the columns in ``carry`` (None: all).

    Columns of ``docs`` that have the name of a result are replaced.
    """
    results = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    value = F.coalesce(F.col(text), F.lit(""))
    # lower-casing A-Z leaves the place of every character, so ends are cut before it
    ends = {"__length": F.octet_length(value), "__head": F.translate(F.substring(value, 1, 64), _UPPER, _LOWER), "__tail": F.translate(F.right(value, F.lit(64)), _UPPER, _LOWER)}
    several = docs.select(*[c.alias(k) for k, c in ends.items()]).groupBy(*ends).agg(F.count("*").alias("__many")).filter("__many > 1")
    names0 = stored(several.sortWithinPartitions(*ends).withColumn("__name0", F.monotonically_increasing_id()))
    keep = [c for c in docs.columns if c not in results and (carry is None or c in carry)]
    rest = [c for c in keep if c != text]
    wide = docs.select(F.struct(*[F.col(c) for c in rest]).alias("__rest") if rest else F.struct(F.lit(1).alias("one")).alias("__rest"), F.col(row_id).alias("__id"), F.col(text).alias("__text"), *[c.alias(k) for k, c in ends.items()])
    base = stored(
        joined(wide, names0, list(ends), "__many").drop("__head", "__tail")
        .select("*", folded(F.col("__text")).alias("__bytes")).select("*", F.sha2("__bytes", 256).alias("__sha"), F.monotonically_increasing_id().alias("__row"))
        .withColumn("__bytes", F.when(F.col("__name0").isNotNull(), F.col("__bytes")))
    )
    names = stored(document_names(base.filter("__name0 is not null").select("__row", "__bytes"), block))
    slim = stored(base.filter("__name0 is not null").select("__row", "__id", "__length", "__name0").join(names, "__row"))
    group = ["__name0", "__length", "__name"]
    groups = stored(slim.groupBy(*group).agg(F.max(F.struct(F.col("__id").isNotNull().alias("some"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("__last"), F.count("*").alias("__size"))
        .withColumn("__many", F.col("__size")))
    settled = joined(slim, groups, group, "__many").select("__row", F.col("__last.id").alias("__keep"), F.col("__last.row").alias("__last"), F.col("__size"))
    out = base.drop("__bytes", "__name0", "__length").join(settled, "__row", "left")
    single = F.col("__size").isNull()
    return out.select(
        F.col("__id").alias("doc_id"), F.when(single, F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"), F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("__last") == F.col("__row"))).alias("kept"), F.col("__sha").alias("text_sha256"),
        *[F.col(f"__rest.{c}").alias(c) if c != text else F.col("__text").alias(c) for c in keep],
    )

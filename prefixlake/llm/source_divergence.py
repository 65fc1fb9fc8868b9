"""Source divergence audit: how the word use of each source differs from its language's other sources.

An Arrow pipeline in ``mapInArrow`` counts terms: ``ascii_lower``, ``split_pattern_regex``,
``dictionary_encode`` and hash ``group_by``, first by document, then by (language, source). Its
partial counts meet once, dealt by (language, term). A language keeps the terms in at least
``min_docs`` of its documents. The kept counts are cut into shards of a language's terms, of a
bounded number of cells (terms x sources); a task spreads a shard out as columns of shares and
emits sums of differences by pair of sources and the shard's highest terms of each source.

Shares are whole numbers: 1 + floor(SCALE * (count + 5) / (N + 5 * V)); all arithmetic is exact.

Defined results: null text, language and source count as the empty string; every row counts as a
document, repeated rows too; a text without terms (also an empty one) still makes its group occur;
texts are never cut, however long; equal values rank by the item's UTF-8 bytes; an empty table
gives an empty result. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.common import stored

#: What separates terms: ASCII characters other than letters.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
SMOOTH = 5
#: Cells (terms x sources) of a shard, on average: the least and the most (between them four for each pair of sources).
CELLS = (1 << 16, 1 << 22)
#: Distinct counts a task holds back.
HELD = 400_000
#: Most languages whose sizes are broadcast.
BROADCAST_LANGS = 100_000
_KEYS = ["lang", "source", "term"]


def count_terms(texts: pa.Array, group: pa.Array) -> pa.Table:
    """(group, term, n, docs) of a batch: occurrences, and documents that hold the term."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    terms = pc.list_flatten(lists).dictionary_encode()
    used = pc.not_equal(terms.dictionary, "")
    pairs = pa.table({"doc": pc.list_parent_indices(lists), "code": terms.indices})
    by_doc = pairs.filter(pc.take(used, terms.indices)).group_by(["doc", "code"]).aggregate([([], "count_all")])
    by_group = pa.table({"group": pc.take(group, by_doc["doc"]), "code": by_doc["code"], "n": by_doc["count_all"]}).group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table({"group": by_group["group"], "term": pc.take(terms.dictionary, by_group["code"]), "n": by_group["n_sum"], "docs": by_group["count_all"]})


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.table({**{k: sums[k] for k in _KEYS}, "n": sums["n_sum"], "docs": sums["docs_sum"]})

    for batch in batches:
        text, lang, source = (pc.fill_null(batch.column(i), "") for i in range(3))
        groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"], use_threads=False).aggregate([])
        code = {k: i for i, k in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist(), strict=True))}
        group = pa.array([code[k] for k in zip(lang.to_pylist(), source.to_pylist(), strict=True)], pa.int32())
        counts = count_terms(text, group)
        held.append(pa.table({"lang": pc.take(groups["lang"], counts["group"]), "source": pc.take(groups["source"], counts["group"]), "term": counts["term"], "n": counts["n"], "docs": counts["docs"]}))
        size += counts.num_rows
        if size > HELD:
            held = [merged()]
            if (size := held[0].num_rows) > HELD // 2:
                yield from held[0].combine_chunks().to_batches()
                held, size = [], 0
    if size:
        yield from merged().combine_chunks().to_batches()


def kept_counts(docs: DataFrame, text: Column, lang: Column, source: Column, min_docs: int) -> DataFrame:
    """(lang, term, source, n) of the terms in at least ``min_docs`` documents of the language."""
    slim = docs.select(text.alias("text"), lang.alias("lang"), source.alias("source"))
    partial = slim.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    # dealt by (lang, term) once: the sums by source and by language both use that dealing
    sums = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return sums.withColumn("docs", everywhere).filter(F.col("docs") >= min_docs).select("lang", "term", "source", "n")


def share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact in 64 bits by long division."""
    whole = total + SMOOTH * terms
    if whole >= 1 << 53:
        raise ValueError("counts are too large for 64-bit long division")
    rest, out = count.astype(np.int64) + SMOOTH, np.zeros(count.shape, dtype=np.int64)
    step = 1000
    for _ in range(3):  # SCALE = step ** 3
        rest = rest * step
        digit = rest // whole
        out, rest = out * step + digit, rest - digit * whole
    return out + 1


def _shard_batches(top: int):
    """Of one shard: sums by pair of sources (the smaller named first), and each source's highest terms."""

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        names = groups["source"].to_pylist()
        totals, whole, terms_in_lang = groups["total"].to_pylist(), groups["lang_total"][0].as_py(), groups["terms"][0].as_py()
        place = {s: i for i, s in enumerate(names)}
        terms = counts["term"].dictionary_encode().combine_chunks() if counts.num_rows else None
        words = terms.dictionary.to_pylist() if counts.num_rows else []
        cells = np.zeros((len(names), len(words)), dtype=np.int64)
        if words:
            cells[[place[s] for s in counts["source"].to_pylist()], terms.indices.to_numpy()] = counts["n"].to_numpy()
        shares = np.empty_like(cells)
        for i, total in enumerate(totals):
            shares[i] = share(cells[i], total, terms_in_lang)
        common = share(cells.sum(axis=0), whole, terms_in_lang)
        out: dict[str, list] = {"part": [], "source": [], "item": [], "value": []}
        for i, name in enumerate(names):
            others = np.abs(shares[i + 1 :] - shares[i]).sum(axis=1)
            out["part"] += ["pair"] * len(others)
            out["source"] += [name] * len(others)
            out["item"] += names[i + 1 :]
            out["value"] += others.tolist()
            over = np.flatnonzero((cells[i] > 0) & (shares[i] > common))
            gain = shares[i][over] - common[over]
            if len(over) > top:  # nothing below the top-th highest value, whatever its rank among equals
                over = over[gain >= np.partition(gain, -top)[-top]]
            best = sorted(((int(shares[i][t] - common[t]), words[t]) for t in over), key=lambda x: (-x[0], x[1].encode()))[:top]
            out["part"] += ["term"] * len(best)
            out["source"] += [name] * len(best)
            out["item"] += [w for _, w in best]
            out["value"] += [v for v, _ in best]
        n = len(out["part"])
        return pa.table({"lang": pa.array([lang] * n, pa.string()), "part": pa.array(out["part"], pa.string()), "source": pa.array(out["source"], pa.string()), "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})

    return run


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances to each other source, and the terms a source uses more than its language."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, lang, source)]
    kept = stored(kept_counts(docs, *name, min_docs))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    occurring = docs.select(name[1].alias("lang"), name[2].alias("source")).distinct()
    sizes = terms.join(occurring.groupBy("lang").agg(F.count("*").alias("sources")), "lang", "right")
    cells = F.least(F.greatest(F.lit(CELLS[0]), 4 * F.col("sources") * F.col("sources")), F.lit(CELLS[1]))
    shards = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("terms"), F.lit(0)).cast("double") * F.col("sources") / cells)).cast("int")
    langs = stored(sizes.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), shards.alias("shards")))
    # a language may hold a third of all counts: they meet this table where they are, unless it has very many rows
    langs = F.broadcast(langs) if langs.count() <= BROADCAST_LANGS else langs
    groups = stored(occurring.join(totals, ["lang", "source"], "left").join(langs, "lang").fillna({"total": 0}))
    # a language without kept terms has one shard, without rows of counts
    sides = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    dealt = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")).drop("shards")
    parts = stored(dealt.groupBy("lang", "shard").cogroup(sides.groupBy("lang", "shard")).applyInArrow(_shard_batches(top), "lang string, part string, source string, item string, value long"))
    pair = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pair.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("at"), "value").select("lang", "at.source", F.lit("pair").alias("part"), "at.item", "value")
    by_value = [F.col("value").desc(), F.col("item")]
    term = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    top_terms = term.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).filter(F.col("rank") <= top)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).unionByName(top_terms)

"""Sharding by histogram sort: near-equal bytes, one exchange, DataFrame operations only.

Rows are ordered by the key (hash of the text, hash of the id), so copies of one text lie side
by side and still can be cut apart. The key space is probed, not sampled: each round counts the
exact bytes and rows below evenly spaced candidate boundaries inside the intervals that still
hold a splitter, until every splitter is within the tolerance or its interval holds one key.
Shards are cut further into cells of bounded size; since the rows below each cell are known, a
row's slot is its cell's offset plus its place in the cell, and no task sorts a whole shard.

Defined results: a null text has size 16 (no bytes) and the checksum 0; an empty table gives an
empty result; repeated rows (same text and id) share a key, stay in one cell and get different
slots; shards may stay empty when there are fewer rows than shards. Extra columns pass through;
a column with the name of a result is replaced.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.common import stored

#: Bits of each half of the key.
KEY_BITS = 60
#: Most histogram bins a round brings to the driver.
BINS = 1 << 18
#: Bits of the first histogram, by which rows find their splitters.
FIRST_BITS = 12
#: Most cells: bounds the broadcast splitter table.
MAX_CELLS = 1 << 16
#: Bytes of a cell, where the bound on cells allows.
CELL_BYTES = 256 << 20


def row_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)


def _keys(text: str, row_id: str) -> list[Column]:
    half = 64 - KEY_BITS
    return [
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), half).alias("__k1"),
        F.shiftrightunsigned(F.xxhash64(F.lit("id"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))), half).alias("__k2"),
    ]


class _Interval:
    """Keys [low, high) of one level that hold splitters; ``done`` once it can't be refined."""

    def __init__(self, fixed: int | None, prefix: int, bits: int, bytes_below: int, rows_below: int, nbytes: int, rows: int, one: bool):
        self.fixed, self.prefix, self.bits = fixed, prefix, bits  # fixed: the whole first half, when the second is probed
        self.bytes_below, self.rows_below, self.nbytes, self.rows, self.one = bytes_below, rows_below, nbytes, rows, one

    def low(self) -> tuple[int, int]:
        at = self.prefix << (KEY_BITS - self.bits)
        return (at, 0) if self.fixed is None else (self.fixed, at)

    def high(self) -> tuple[int, int]:
        at = (self.prefix + 1) << (KEY_BITS - self.bits)
        return (at, 0) if self.fixed is None else (self.fixed, at)


def _histogram(keys: DataFrame, wanted: list[_Interval], bits: int) -> dict[tuple, list]:
    """Exact bytes and rows of each sub-interval, ``bits`` finer, of the wanted intervals (all of one level)."""
    second, old = wanted[0].fixed is not None, wanted[0].bits
    finer = F.shiftright(F.col("__k2" if second else "__k1"), KEY_BITS - old - bits).alias("__bin")
    if old or second:
        spark = keys.sparkSession
        coarse = F.shiftright(F.col("__k2" if second else "__k1"), KEY_BITS - old) if old else F.lit(0).cast("long")
        table = spark.createDataFrame([(w.fixed if second else w.prefix, w.prefix) for w in wanted], "__f long, __p long")
        on = (F.col("__f") == F.col("__k1")) & (F.col("__p") == coarse) if second else F.col("__f") == coarse
        keys = keys.join(F.broadcast(table), on)
    group = ["__k1"] if second else []
    rows = keys.groupBy(*group, finer).agg(F.sum("__size").alias("b"), F.count("*").alias("n"), F.min("__k1").alias("a1"), F.max("__k1").alias("z1"), F.min("__k2").alias("a2"), F.max("__k2").alias("z2")).collect()
    found: dict[tuple, list] = {}
    for r in rows:
        found.setdefault((r["__k1"] if second else None, r["__bin"] >> bits), []).append(r)
    return found


def splitters(keys: DataFrame, targets: list[int], tolerance: int) -> list[tuple[tuple[int, int], int, int]]:
    """For each target (bytes to lie below): the boundary key, and the exact bytes and rows below it.

    ``keys`` has ``__k1``, ``__k2`` and ``__size``. A boundary differs from its target by at most
    ``tolerance`` bytes unless a single key spans it; then it is the nearer end of that key.
    """
    best: dict[int, tuple] = {}
    total = keys.agg(F.sum("__size").alias("b"), F.count("*").alias("n")).first()
    open_: list[tuple[_Interval, list[int]]] = [(_Interval(None, 0, 0, 0, 0, total["b"] or 0, total["n"], False), list(range(len(targets))))]
    while open_:
        later: list[tuple[_Interval, list[int]]] = []
        levels: dict[tuple[bool, int], list[tuple[_Interval, list[int]]]] = {}
        for interval, which in open_:
            levels.setdefault((interval.fixed is not None, interval.bits), []).append((interval, which))
        for (_, old), group in levels.items():
            bits = FIRST_BITS if not old else max(4, min(FIRST_BITS, (BINS // len(group)).bit_length() - 1))
            bits = min(bits, KEY_BITS - old)
            found = _histogram(keys, [w for w, _ in group], bits)
            for interval, which in group:
                bins = sorted(found.get((interval.fixed, interval.prefix), []), key=lambda r: r["__bin"])
                below, rows, inside = interval.bytes_below, interval.rows_below, []
                for r in bins:
                    inside.append(_Interval(interval.fixed, r["__bin"], old + bits, below, rows, r["b"], r["n"], r["n"] == 1 or (r["a1"], r["a2"]) == (r["z1"], r["z2"])))
                    if r["a1"] == r["z1"] and interval.fixed is None and not inside[-1].one:  # one text: probe the ids
                        inside[-1] = _Interval(r["a1"], 0, 0, below, rows, r["b"], r["n"], False)
                    below, rows = below + r["b"], rows + r["n"]
                edges = [x.bytes_below for x in inside]
                need: dict[int, list[int]] = {}
                for t in which:
                    at = max(0, bisect_right(edges, targets[t]) - 1)
                    x = inside[at]
                    left, right = targets[t] - x.bytes_below, x.bytes_below + x.nbytes - targets[t]
                    if min(left, right) <= tolerance or x.one or x.bits == KEY_BITS:
                        whole = x.fixed is not None and x.bits == 0
                        low, high = ((x.fixed, 0), (x.fixed + 1, 0)) if whole else (x.low(), x.high())
                        best[t] = (low, x.bytes_below, x.rows_below) if left <= right else (high, x.bytes_below + x.nbytes, x.rows_below + x.rows)
                    else:
                        need.setdefault(at, []).append(t)
                later += [(inside[at], ts) for at, ts in need.items()]
        open_ = later
    return [best[t] for t in range(len(targets))]


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", row_id: str = "doc_id", tolerance: float = 0.0005, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard, dealt out by cell."""
    spark = docs.sparkSession
    results = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keys = stored(docs.select(*_keys(text, row_id), row_size(text).alias("__size")))
    total = keys.agg(F.sum("__size")).first()[0] or 0
    parts = max(1, min(-(-total // (shards * cell_bytes)), MAX_CELLS // shards))
    cells = shards * parts
    targets = [total * i // cells for i in range(1, cells)]
    cuts = splitters(keys, targets, int(tolerance * total / shards)) if total else []
    rows_below = [0, *(c[2] for c in cuts)]
    base: dict[int, list] = {}
    for i, (key, _, _) in enumerate(cuts):
        base.setdefault(min(key[0] >> (KEY_BITS - FIRST_BITS), (1 << FIRST_BITS) - 1), []).append((key[0], key[1], i + 1))
    table, last = [], 0
    for b in range(1 << FIRST_BITS):  # each row finds the few splitters of its bin
        inside = base.get(b, [])
        table.append((b, last, inside))
        last = inside[-1][2] if inside else last
    lookup = spark.createDataFrame(table, "__b int, __base int, __cuts array<struct<k1:long,k2:long,cell:int>>")
    offsets = spark.createDataFrame([(i, rows_below[i] - rows_below[i // parts * parts]) for i in range(len(rows_below))], "__cell int, __offset long")
    steps = list(range(max(1, (max([len(x) for *_, x in table], default=1)).bit_length()) - 1, -1, -1))

    def below(at: Column) -> Column:
        cut = F.element_at("__cuts", at)
        return (cut["k1"] < F.col("__k1")) | ((cut["k1"] == F.col("__k1")) & (cut["k2"] <= F.col("__k2")))

    found = F.aggregate(F.array(*[F.lit(1 << s) for s in steps]), F.lit(0), lambda at, step: F.when((at + step <= F.size("__cuts")) & below(F.least(at + step, F.greatest(F.size("__cuts"), F.lit(1)))), at + step).otherwise(at))
    cell = F.when((F.size("__cuts") > 0) & (found > 0), F.element_at("__cuts", F.greatest(found, F.lit(1)))["cell"]).otherwise(F.col("__base"))
    rows = docs.drop(*results).select("*", row_size(text).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), *_keys(text, row_id))
    placed = (
        rows.withColumn("__b", F.shiftright("__k1", KEY_BITS - FIRST_BITS).cast("int")).join(F.broadcast(lookup), "__b").withColumn("__cell", cell)
        .drop("__b", "__base", "__cuts").join(F.broadcast(offsets), "__cell")
    )
    order = Window.partitionBy("__cell").orderBy("__k1", "__k2", F.col(row_id).asc_nulls_first())
    return placed.select(
        *[F.col(c) for c in docs.columns if c not in results], "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("__cell") / parts).cast("int").alias("shard"),
        (F.col("__offset") + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

"""Mixing sources to target weights by cube-method balanced sampling.

A source with target T and size S takes each of its documents floor(T/S) times, and once more
with the inclusion probability frac(T/S). The cube method decides which: inclusion probabilities
move through the null space of the balancing constraints (number of documents, number of words)
until they are 0 or 1. A flight runs over one block of a source; what stays fractional (two
documents a block at most) is gathered into new blocks, level by level, until one block per
source is left; the landing rounds its last documents to the nearest word total.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words;
a target stops at three times its source's size, the excess is shared again by weight.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own;
an empty table gives an empty result. Random choices depend on the seed, the source and the ids
alone, so reruns agree; rows repeated with one id are decided one by one.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Documents of a flight block, on average.
BLOCK = 4096
_EPS = 1e-9


def source_targets(sizes: DataFrame, cycle: int = 3, cap: int = CAP) -> DataFrame:
    """(__source, __total, __target) from (__source, __total), one row per source."""
    ranked = stored(sizes.orderBy(F.col("__source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["n"]) for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, so_far = [], 0
    for p, n in counts:  # one row per partition
        offsets.append((p, so_far))
        so_far += n
    starts = sizes.sparkSession.createDataFrame(offsets, "__p long, __start long")
    ranked = ranked.join(F.broadcast(starts), part == F.col("__p")).select("__source", "__total", (F.pmod(F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1), F.lit(cycle)) + 1).alias("__weight"))
    whole = ranked.agg(F.sum("__total").alias("t"), F.sum("__weight").alias("w")).first()
    total, share, capped = whole["t"] or 0, (whole["t"] or 0) / (whole["w"] or 1), -1
    while True:
        over = F.lit(share) * F.col("__weight") > cap * F.col("__total")
        now = ranked.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, cap * F.col("__total"))).alias("kept"), F.sum(F.when(~over, F.col("__weight"))).alias("w")).first()
        if now["n"] == capped or not now["w"]:
            break
        capped, share = now["n"], (total - (now["kept"] or 0)) / now["w"]
    return ranked.select("__source", "__total", F.least(F.lit(float(share)) * F.col("__weight"), (cap * F.col("__total")).cast("double")).alias("__target"))


def flight(size: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Inclusion probabilities after the flight: at most two stay fractional.

    Keeps the sum of the probabilities and the sum of size times probability, and is fair:
    each step's expectation is where it started.
    """
    out = list(chance)
    held: list[int] = []
    for i in range(len(out)):
        if _EPS < out[i] < 1 - _EPS:
            held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]  # null space of (1, 1, 1) and the sizes
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min(((1 - out[k]) / v if v > 0 else -out[k] / v) for k, v in zip(held, u, strict=True) if v)
        down = min((out[k] / v if v > 0 else (out[k] - 1) / v) for k, v in zip(held, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(held, u, strict=True):
            out[k] += step * v
            if out[k] <= _EPS or out[k] >= 1 - _EPS:
                out[k] = float(round(out[k]))
        held = [k for k in held if _EPS < out[k] < 1 - _EPS]
    return out


def landing(size: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Round what is fractional so that the words come nearest to their expectation; ties by chance."""
    open_ = [i for i, p in enumerate(chance) if _EPS < p < 1 - _EPS]
    if not open_:
        return chance
    aim = sum(size[i] * chance[i] for i in open_)
    number = sum(chance[i] for i in open_)
    options = [[(m >> k) & 1 for k in range(len(open_))] for m in range(1 << len(open_))]
    best = min(options, key=lambda o: (abs(sum(size[i] * x for i, x in zip(open_, o, strict=True)) - aim), abs(sum(o) - number), rng.random()))
    out = list(chance)
    for i, x in zip(open_, best, strict=True):
        out[i] = float(x)
    return out


def _fly(seed: int, level: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what stays fractional is small
        group = group.sort_values(["__size", "__order", "__key"], ascending=[False, True, True], kind="stable")
        name = group["__source"].iloc[0]
        rng = random.Random(f"{seed}/{level}/{group['__block'].iloc[0]}/{zlib.crc32(b'' if name is None else str(name).encode('utf-8', 'surrogatepass'))}/{name is None}")
        size, chance = group["__size"].astype(float).tolist(), group["__chance"].tolist()
        moved = flight(size, chance, rng)
        group = group.assign(__chance=np.array(landing(size, moved, rng) if last else moved))
        return group[["__row", "__source", "__size", "__order", "__key", "__chance"]]

    return run


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", cap: int = CAP, block: int = BLOCK, seed: int = 0, carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, copies, taken, and the columns in ``carry`` (None: all).

    Columns of ``docs`` that have the name of a result are replaced.
    """
    results = ["doc_id", "size", "source_size", "target", "copies", "taken"]
    keep = [c for c in docs.columns if c not in results and (carry is None or c in carry)]
    wide = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("__rest") if keep else F.struct(F.lit(1).alias("one")).alias("__rest"), F.col(row_id).alias("__id"), F.col(source).alias("__source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
    )
    base = stored(wide.withColumn("__row", F.monotonically_increasing_id()))
    slim = base.select("__row", "__source", "__size", F.xxhash64(F.lit(seed), F.col("__id").cast("string")).alias("__order"), F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("__key"))
    sizes = slim.groupBy("__source").agg(F.sum("__size").alias("__total"))
    targets = stored(source_targets(sizes, cap=cap))
    ratio = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(0.0)
    times = targets.select("*", F.least(F.floor(ratio + _EPS), F.lit(cap)).cast("int").alias("__times"), ratio.alias("__ratio"))
    open_ = slim.join(times.select(F.col("__source").alias("__s"), F.greatest(F.col("__ratio") - F.col("__times"), F.lit(0.0)).alias("__chance")), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    schema = open_.schema
    open_, settled, level = open_.filter(F.col("__chance") > _EPS), [], 0
    while True:
        counts = open_.groupBy("__source").agg(F.count("*").alias("__n")).select(F.col("__source").alias("__s"), F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
        last = (counts.agg(F.max("__blocks")).first()[0] or 0) <= 1
        dealt = open_.join(counts, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__block", F.pmod(F.xxhash64(F.lit(level), "__order", "__size"), F.col("__blocks")))
        flown = stored(dealt.drop("__s", "__blocks").groupBy("__source", "__block").applyInPandas(_fly(seed, level, last), schema))
        settled.append(flown.filter(F.col("__chance") >= 1 - _EPS).select("__row"))
        if last:
            break
        open_, level = flown.filter((F.col("__chance") > _EPS) & (F.col("__chance") < 1 - _EPS)), level + 1
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    out = base.join(chosen.withColumn("__once", F.lit(1)), "__row", "left").join(times.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
    copies = F.col("__times") + F.coalesce("__once", F.lit(0))
    return out.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).cast("long").alias("taken"),
        *[F.col(f"__rest.{c}").alias(c) for c in keep],
    )


def mixed_rows(mix: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken."""
    return mix.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy")

"""Jaccard self-join on word shingles by chosen paths.

Every document becomes a set of five-word shingles; rows with one set form a class of copies
with one representative. A run starts a tree whose nodes choose, by the node's path alone, each
of the 128 min-hash tokens with probability 1 / (threshold * 128), and hand a set on to the child
(path, chosen token): similar sets stay together with the same chance per level, others part.
Buckets of at most SMALL sets are compared by brute force on their signatures. In a larger one
each set is compared with one pivot, once for all buckets that have it: sets that share NEAR of its
tokens are joined to it and so are in one group already. They leave the bucket unless a set far from
the pivot can still be their likely partner (the share of differing tokens is a metric); what is left
is split again. A large group of near copies is thus met once, not level by level. What is still large after DEPTH
levels, sets that agree on every token drawn, is joined to the pivot whole. RUNS trees give the recall: a pair at the threshold meets in a tree with probability 0.63 in a
first-level bucket and 0.37 in a third-level one, so 16 runs miss less than one in a thousand.

The candidates fall into connected groups. Within a group the exact similarity of *all* pairs of
different sets is computed, in square blocks of bounded size spread over the tasks, so links are
exact inside a group and a pair that no tree brought together is found through a common partner.
Only counts and a spanning forest leave a block, never the pairs.

Defined results: a text of one to four words has one shingle of all its words; a text without a
word has no link and is a class of its own; rows that repeat an id count one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlake.llm.common import chunks_of, stored
from prefixlake.llm.words import mix, shingle_sets

WIDTH, THRESHOLD = 5, 0.8
TOKENS, RUNS, DEPTH, SMALL = 128, 16, 4, 64
#: Signatures that agree in this share of tokens or more are candidates: four deviations below the threshold.
LIKELY = 0.66
#: Sets that agree with a pivot in this share of tokens leave its bucket, whatever else is in it.
SAME = 0.9
#: In a large bucket, sets that agree with the pivot in this share of tokens are joined to it. Tokens that
#: differ are a metric: a likely partner of a set that leaves agrees with the pivot in no smaller a share.
NEAR = SAME + LIKELY - 1
#: Sets and shingles of a block of the exact comparison.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles of the small groups that are compared together.
BIN_SHINGLES = 1 << 18
#: Shingle columns multiplied at once.
COLUMNS = 4096
SPAN = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(12345)
_A = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The min-hash tokens of a set, 32 bits each."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, (_A[:, None] * shingles[None, at : at + 2048] + _B[:, None]).min(axis=1), out=low)
    return (low >> _U(32)).astype(np.uint32)


def chosen(path: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, token place) pairs: the places each node chooses, by its path alone."""
    draw = mix(path[:, None] ^ mix(np.arange(1, TOKENS + 1, dtype=np.uint64))[None, :])
    return np.nonzero(draw < _U(int(2**64 / (threshold * TOKENS))))


def _roots(threshold: float, runs: int) -> tuple[np.ndarray, np.ndarray]:
    paths = mix(np.arange(1, runs + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    node, place = chosen(paths, threshold)
    return paths[node], place


def _child(path: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(path + place.astype(np.uint64)) ^ (token.astype(np.uint64) + _U(1)))


def _sketch(text: str, width: int, threshold: float, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, places = _roots(threshold, runs)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            keys, sizes, sketches, buckets = [], [], [], []
            for a, b in chunks_of(texts, [len(t) for t in texts], SPAN):
                for s in shingle_sets(texts[a:b], width):
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    tokens = signature(s)
                    sketches.append((tokens & np.uint32(0xFFFF)).astype(np.uint16).tobytes() if len(s) else None)
                    buckets.append(np.unique(_child(paths, places, tokens[places])).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "__set", "__n", "__tokens", "__buckets"],
            )

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, pivot, tokens, pivot_tokens) -> (rep, pivot, agree): the share of tokens in which the two agree."""
    for batch in batches:
        tokens, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, TOKENS) for c in ("tokens", "pivot_tokens"))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("pivot"), pa.array((tokens == other).mean(axis=1))], names=["rep", "pivot", "agree"])


def _split(threshold: float):
    """(rep, tokens, held: buckets with far) -> (rep, children: child buckets with far), a set and its tokens once for all its buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            sizes = np.diff(held.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            path, far = (held.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("bucket", "far"))
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), dtype=np.uint16).reshape(-1, TOKENS)
            nodes, inverse = np.unique(path.view(np.uint64), return_inverse=True)
            node, place = chosen(nodes, threshold)
            begin, end = np.searchsorted(node, inverse), np.searchsorted(node, inverse, side="right")
            many = end - begin
            row = np.repeat(np.arange(len(path)), many)
            at = place[np.repeat(begin, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            child = _child(path.view(np.uint64)[row], at, tokens[owner[row], at]).view(np.int64)
            offsets = np.append(0, np.cumsum(np.bincount(owner[row], minlength=len(sizes)))).astype(np.int32)
            children = pa.StructArray.from_arrays([pa.array(child, pa.int64()), pa.array(far[row].astype(bool))], names=["bucket", "far"])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(pa.array(offsets), children)], names=["rep", "children"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """For a boolean matrix of links: the smallest place each place is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(likely: float):
    """Rows (list, rep, tokens), the rows of a list together -> (a, b) that join likely partners."""
    def edges(reps: np.ndarray, tokens: np.ndarray) -> list[tuple[int, int]]:
        agree = (tokens[:, None, :] == tokens[None, :, :]).mean(axis=2)
        root = _forest(agree >= likely)
        return [(int(reps[i]), int(reps[r])) for i, r in enumerate(root) if i != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None

        def flush() -> list[tuple[int, int]]:
            return edges(np.array([r for r, _ in held]), np.frombuffer(b"".join(t for _, t in held), dtype=np.uint16).reshape(-1, TOKENS)) if len(held) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, rep, tokens in zip(*(batch.column(c).to_pylist() for c in ("list", "rep", "tokens")), strict=True):
                if key != name:
                    out += flush()
                    held, name = [], key
                held.append((rep, tokens))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
        out = flush()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it is connected with.

    Every node moves to its smallest neighbour, the edges move with their ends, loops vanish;
    what is left, far fewer edges between the nodes moved to, goes round again.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    left, roots = stored(edges.filter("a <> b").select(both.alias("edge")).select("edge.*").distinct()), None
    while True:
        step = stored(left.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            roots = roots.join(step, F.col("root") == F.col("a"), "left").select("node", F.coalesce("m", "root").alias("root"))
        moved = left.join(step, "a").select(F.col("m").alias("x"), "b")
        moved = moved.join(step.select(F.col("a").alias("b"), "m"), "b").select(F.col("x").alias("a"), F.col("m").alias("b")).filter("a <> b")
        left = stored(moved.distinct())
        if left.isEmpty():
            return roots


def candidate_groups(reps: DataFrame, threshold: float = THRESHOLD, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """(node, root): connected groups of likely partners among ``reps`` (rep, tokens, buckets)."""
    rows, small_buckets, found = reps.select("rep", F.explode("buckets").alias("bucket"), F.lit(True).alias("far")), [], []
    for level in range(1, depth + 1):
        first = F.min(F.struct((~F.col("far")).alias("joined"), "rep"))
        counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1 and not first.joined")
        rows = stored(rows.join(counts.select("bucket", "n", F.col("first.rep").alias("pivot")), "bucket").drop("far"))
        small_buckets.append(rows.filter(F.col("n") <= small).select(F.lit(level).alias("level"), "bucket", "rep"))
        large = rows.filter(F.col("n") > small)
        if large.isEmpty():
            break
        if level == depth:
            found.append(large.select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        else:
            pivots = reps.select(F.col("rep").alias("pivot"), F.col("tokens").alias("pivot_tokens"))
            pairs = large.select("rep", "pivot").distinct().join(reps.select("rep", "tokens"), "rep").join(pivots, "pivot")
            tested = stored(pairs.mapInArrow(_agreement, "rep long, pivot long, agree double"))
            found.append(tested.filter((F.col("agree") >= NEAR) & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
            marked = stored(large.join(tested, ["rep", "pivot"]).withColumn("far", F.col("agree") < NEAR))
            nearest = marked.filter("far").groupBy("bucket").agg(F.max("agree").alias("nearest"))
            # a joined set's likely partner among the far ones agrees with the pivot in at least this share
            able = F.col("far") | (F.col("nearest") >= F.col("agree") + LIKELY - 1)
            going = marked.join(nearest, "bucket").filter(able).groupBy("rep").agg(F.collect_list(F.struct("bucket", "far")).alias("held"))
            split = going.join(reps.select("rep", "tokens"), "rep").mapInArrow(_split(threshold), "rep long, children array<struct<bucket: bigint, far: boolean>>")
            rows = stored(split.select("rep", F.explode("children").alias("child")).select("child.bucket", "rep", "child.far"))
    # the small buckets of all levels are compared in one step, each list of members once
    lists = reduce(DataFrame.unionByName, small_buckets).groupBy("level", "bucket").agg(F.sort_array(F.collect_list("rep")).alias("members")).select("members").distinct()
    members = lists.select(F.xxhash64("members").alias("list"), F.explode("members").alias("rep")).join(reps.select("rep", "tokens"), "rep")
    compared = members.repartition("list").sortWithinPartitions("list").select("list", "rep", "tokens").mapInArrow(_compare(LIKELY), "a long, b long")
    return components(reduce(DataFrame.unionByName, found, compared))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets."""
    tokens = np.concatenate([*left, *right]) if left and right else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    common = counts > 1
    place = np.cumsum(common) - 1
    keep = common[inverse]
    owner, column = owner[keep], place[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    total = int(common.sum())
    cuts = np.searchsorted(column, range(0, total + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a == b:
            continue
        has = np.zeros((len(left) + len(right), min(COLUMNS, total - i * COLUMNS)), dtype=np.float32)
        has[owner[a:b], column[a:b] - i * COLUMNS] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _verify(threshold: float, text: str, width: int):
    """Rows of one (bin, i, j) -> per set: links of this block and a spanning forest."""
    def pair(p: list[int], q: list[int], same: bool, rep: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
        left, right = [sets[i] for i in p], [sets[i] for i in q]
        shared = shared_counts(left, right)
        size = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
        linked = shared * (1 + threshold) >= threshold * size - 1e-3
        if same:
            np.fill_diagonal(linked, False)
        out = []
        whole = np.zeros((len(p) + len(q),) * 2, dtype=bool) if not same else linked | linked.T
        if not same:
            whole[: len(p), len(p) :] = linked
            whole[len(p) :, : len(p)] = linked.T
        members = p if same else [*p, *q]
        degree = [(int(linked[i].sum()), int(copies[q][linked[i]].sum())) for i in range(len(p))]
        if not same:
            degree += [(int(linked[:, j].sum()), int(copies[p][linked[:, j]].sum())) for j in range(len(q))]
        root = _forest(whole)
        for i, (sets_, docs_) in enumerate(degree):
            if sets_:
                out.append((int(rep[members[i]]), int(rep[members[root[i]]]), sets_, docs_))
        return out

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("rep", "ascending")])
        root, rep, block, copies = (table.column(c).to_numpy() for c in ("root", "rep", "block", "copies"))
        texts = [t or "" for t in table.column(text).to_pylist()]
        sets = [s for a, b in chunks_of(texts, [len(t) for t in texts], SPAN) for s in shingle_sets(texts[a:b], width)]
        i, j = key[1].as_py(), key[2].as_py()
        many = key[3].as_py() > 1
        out: list[tuple] = []
        bounds = np.flatnonzero(np.diff(root, prepend=root[0] - 1))  # a group is never empty
        for a, b in zip(bounds, np.append(bounds, len(root))[1:], strict=True):
            at = np.arange(a, b)
            p, q = at[block[a:b] == i].tolist(), at[block[a:b] == j].tolist()
            out += pair(p, q, i == j, rep, copies, sets)
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("a", "b", "set_links", "doc_links"), columns, strict=True)} | {"many": pa.array([many] * len(out), pa.bool_())})

    return run


def jaccard_join(docs: DataFrame, text: str = "text", row_id: str = "doc_id", threshold: float = THRESHOLD, width: int = WIDTH, runs: int = RUNS) -> DataFrame:
    """``docs`` with class_id, class_size, n_links, n_set_links, stays.

    A class is a connected group of linked rows, named by its smallest id; ``n_links`` counts the
    row's partners among all other rows, ``n_set_links`` its partners with a different shingle set;
    one row of each class stays, the one with the smallest id. Columns of ``docs`` that have the
    name of a result are replaced.
    """
    results = ["class_id", "class_size", "n_links", "n_set_links", "stays"]
    source = docs.drop(*results).withColumn("__row", F.monotonically_increasing_id())
    fields = [*source.schema.fields, T.StructField("__set", T.BinaryType()), T.StructField("__n", T.IntegerType()), T.StructField("__tokens", T.BinaryType()), T.StructField("__buckets", T.ArrayType(T.LongType()))]
    base = stored(source.mapInArrow(_sketch(text, width, threshold, runs), T.StructType(fields)))
    order = F.struct(F.col(row_id).isNull().alias("none"), F.col(row_id).alias("id"), F.col("__row").alias("row"))
    sets = stored(base.filter(F.col("__set").isNotNull()).groupBy("__set").agg(F.min(order).alias("__first"), F.count("*").alias("__copies")).withColumn("rep", F.col("__first.row")))
    reps = base.join(sets.select(F.col("rep").alias("__row"), F.col("__copies").alias("copies")), "__row").select(F.col("__row").alias("rep"), "copies", F.col("__n").alias("n"), F.col("__tokens").alias("tokens"), F.col("__buckets").alias("buckets"))
    reps = stored(reps)
    groups = stored(candidate_groups(reps, threshold).join(reps.select(F.col("rep").alias("node"), "copies", "n"), "node"))
    # exact comparison within each group: blocks of bounded size, small groups several to a task
    shape = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    bins = max(1, -(-(groups.agg(F.sum("n")).first()[0] or 0) // BIN_SHINGLES))
    dealt = groups.join(shape, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))))
    where = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", F.lit("own")))
    dealt = dealt.select(F.col("node").alias("__row"), "root", "copies", "block", "blocks", where.alias("bin"), "pair.i", "pair.j")
    loaded = dealt.hint("merge").join(base.select("__row", F.col(text).alias("__text")), "__row").withColumnRenamed("__row", "rep")
    links = stored(loaded.groupBy("bin", "i", "j", "blocks").applyInArrow(_verify(threshold, "__text", width), "a long, b long, set_links long, doc_links long, many boolean"))
    degrees = links.groupBy(F.col("a").alias("rep")).agg(F.sum("set_links").alias("__sl"), F.sum("doc_links").alias("__dl"))
    # a group in one block has its classes already; those in several are put together from their blocks
    roots = links.filter("not many").select(F.col("a").alias("rep"), F.col("b").alias("root"))
    pieces = links.filter("many")
    if not pieces.isEmpty():
        roots = roots.union(components(pieces.select("a", "b")).select(F.col("node").alias("rep"), "root"))
    classes = stored(sets.join(roots, "rep", "left").join(degrees, "rep", "left").select("__set", "__first", "__copies", F.coalesce("root", "rep").alias("__class"), F.coalesce("__sl", F.lit(0)).alias("__sl"), F.coalesce("__dl", F.lit(0)).alias("__dl")))
    whole = classes.groupBy("__class").agg(F.min("__first").alias("__low"), F.sum("__copies").alias("__size"))
    out = base.drop("__n", "__tokens", "__buckets").join(classes.join(whole, "__class"), "__set", "left")
    alone = F.col("__class").isNull()
    return out.select(
        *[F.col(c) for c in docs.columns if c not in results],
        F.when(alone, F.col(row_id)).otherwise(F.col("__low.id")).alias("class_id"), F.coalesce("__size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("__dl") + F.col("__copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("__sl", F.lit(0)).cast("long").alias("n_set_links"),
        (alone | (F.col("__low.row") == F.col("__row"))).alias("stays"),
    )

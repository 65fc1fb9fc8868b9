import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from prefixlake.llm import block_names, chosen_path, cube_mix, histogram_shards, impact_search, queries
from tests.llm.helpers import SF, awkward_documents, empty_documents, plain_shingles

SF2 = SF.replace("0.001", "0.01")


def test_shards_hold_equal_bytes(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    out = queries.op2_histogram_shards(spark, SF2).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in out:
        text = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest + 0.002 * sum(sizes.values()) / 40


def test_shards_with_a_hot_text_and_many_cells(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text " * 9)).otherwise(F.repeat(F.lit("x"), (F.col("id") % 400).cast("int"))).alias("text"))
    out = histogram_shards.shard_documents(docs, shards=7, cell_bytes=20_000)
    rows = out.select("doc_id", "size", "shard", "slot").collect()
    assert len({r["doc_id"] for r in rows}) == 6000
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 7
    assert len(sizes) == 7 and all(abs(s - mean) <= 0.01 * mean for s in sizes.values())
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in histogram_shards.shard_documents(docs, shards=7, cell_bytes=20_000).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_shards_of_awkward_rows(spark):
    docs = awkward_documents(spark)
    out = histogram_shards.shard_documents(docs, shards=4)
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns) and all(0 <= r["shard"] < 4 for r in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((s, i) for s in range(4) for i in range(sum(r["shard"] == s for r in rows)))
    assert histogram_shards.shard_documents(empty_documents(spark)).count() == 0


def _sql(name: str, sf: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return sorted(con.execute(queries.oracle_sql()[name]).fetchall())


def test_top_k_equals_sql(spark):
    assert sorted(map(tuple, queries.op4_exact_top_k(spark, SF2).collect())) == _sql("op4_exact_top_k", SF2)


def test_top_k_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        v = [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(rng.choice([8, 8, 8, 5, 0]))]
        if i % 50 == 7:
            v = [float("nan"), 1.0]
        if i % 50 == 8:
            v = [None, 1.0]
        if i % 50 == 9:
            v = [float("inf")]
        rows.append((i if i % 90 else i + 1, None if i % 50 == 10 else v, "clash"))
    rows += [(None, [1.0], "clash"), (100, [9.0] * 8, "clash"), (350, [1.0, 2.0], "clash"), (350, [1.0, 2.0], "clash")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    asked = df.filter("vec_id % 10 = 0")
    fine = [(i, [int(np.floor(1024 * x)) for x in v], v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, *_ in fine if i % 10 == 0}):
        qv = [int(np.floor(1024 * x)) for x in min(v for i, _, v in fine if i == q)]
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v, _ in fine if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, impact_search.top_k(df, asked).collect())) == want
    assert impact_search.top_k(df.limit(0), asked.limit(0)).count() == 0
    assert impact_search.top_k(df, asked.limit(0)).count() == 0
    few = df.filter("vec_id < 5")
    assert impact_search.top_k(few, few.filter("vec_id = 2")).count() == few.count() - 1


def test_search_block_stops_on_proof_only():
    rng = np.random.default_rng(5)
    for trial in range(20):
        x = np.floor(rng.normal(0, 1, (300, 12)) ** (3 if trial % 2 else 1) * 1024)
        q = np.floor(rng.normal(0, 1, (9, 12)) * 1024)
        ids, qids = np.arange(300) * 7 % 300, np.arange(1000, 1009)
        qi, found, scores = impact_search.search_block(qids, q, ids, x, 10, np.full(9, -np.inf))
        full = (q @ x.T).astype(np.int64)
        for i in range(9):
            want = sorted(zip(-full[i], ids, strict=True))[:10]
            assert [(-s, v) for s, v in zip(np.array(scores)[qi == i], found[qi == i], strict=True)] == [(a, b) for a, b in want]


def test_large_components_are_exact(spark):
    rows = [(i, [float(i) * 1e11, 3.0]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = spark.createDataFrame([(100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in impact_search.top_k(df.union(small), small).orderBy("rank").collect()]
    assert got == list(range(29, 19, -1))


def test_exact_copies_equal_sql(spark):
    assert sorted(map(tuple, queries.op6_block_names(spark, SF2).collect())) == _sql("op6_block_names", SF2)


def test_exact_copies_with_small_blocks(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB") for _ in range(rng.choice([0, 1, 7, 8, 9, 63, 64, 65, 200]))) for _ in range(150)]
    texts += ["q" * 70 + x + "q" * 70 for x in "abcabC"] + ["é" * 100, "É" * 100]
    rows = [(i, rng.choice(texts)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lower = {i: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for i, t in rows}
    groups = defaultdict(list)
    for i, t in lower.items():
        groups[t].append(i)
    want = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in lower.items())
    got = block_names.exact_copies(docs, block=8, carry=[])
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == want


def test_exact_copies_of_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("kept", F.lit("clash"))
    out = block_names.exact_copies(docs).collect()
    assert len(out) == docs.count()
    fold = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    groups = defaultdict(list)
    for r in out:
        groups[fold(r["text"])].append(r)
    for members in groups.values():
        ids = [m["doc_id"] for m in members if m["doc_id"] is not None]
        assert all(m["group_size"] == len(members) and m["keep_id"] == (max(ids) if ids else None) for m in members)
        assert [m["doc_id"] for m in members if m["kept"]] == [max(ids) if ids else None]
    assert block_names.exact_copies(empty_documents(spark)).count() == 0


def _brute_links(rows: list[tuple]) -> tuple[dict, dict]:
    sets = [plain_shingles(t) for _, t in rows]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    links = {i: set() for i in range(len(rows))}
    for i, s in enumerate(sets):
        near = set().union(*(by[x] for x in s)) if s else set()
        for j in near - {i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9:
                links[i].add(j)
    root = list(range(len(rows)))
    for _ in rows:
        low = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
        if low == root:
            break
        root = low
    return links, root


def _check_join(rows: list[tuple], out: list) -> None:
    links, root = _brute_links(rows)
    groups = defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(rows[i][0])
    got = {r["doc_id"]: r for r in out}
    for i, (d, _) in enumerate(rows):
        assert got[d]["n_links"] == len(links[i]), d
        assert got[d]["class_id"] == min(groups[root[i]]) and got[d]["class_size"] == len(groups[root[i]])
        assert got[d]["stays"] == (d == min(groups[root[i]]))


def test_jaccard_join_equals_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text").collect())
    _check_join(rows, queries.op9_jaccard_join(spark, SF2).collect())


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """A group of near copies above every bound, a passage many share, and pairs just at the threshold."""
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", 60)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(30)]
    texts = []
    for _ in range(260):
        t = list(base)
        t[rng.randrange(len(t))] = word()
        texts.append(t)
    texts += [[word() for _ in range(60)] + passage + [word() for _ in range(60)] for _ in range(150)]
    for _ in range(60):
        t = [word() for _ in range(100)]
        texts += [t, t[:-10] + [word() for _ in range(10)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    _check_join(rows, chosen_path.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_jaccard_join_of_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("stays", F.lit("clash"))
    out = chosen_path.jaccard_join(docs).collect()
    assert len(out) == docs.count()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert by[1][0]["class_size"] == 5 and by[1][0]["n_links"] == 4 and sum(r["stays"] for d in (1, 2, 3, None) for r in by[d] if r["text"]) == 1
    assert by[4][0]["class_size"] == 1 and by[4][0]["n_links"] == 0 and by[5][0]["stays"]
    assert by[8][0]["class_id"] == by[9][0]["class_id"] == by[10][0]["class_id"] == 8
    assert chosen_path.jaccard_join(empty_documents(spark)).count() == 0


def _targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        share = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share * weight[s] for s in names}
        capped |= over


def _check_mix(docs: list[tuple], out: list, near: float) -> None:
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")])
    want = _targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(near * want[s], largest[s]), s


def test_mix_meets_targets(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()]
    frame = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text", "source")
    out = cube_mix.mix_sources(frame, carry=["source"]).collect()
    _check_mix(docs, out, 0.002)
    again = cube_mix.mix_sources(frame.repartition(5), carry=["source"], block=4096).collect()
    assert {(r["doc_id"], r["taken"]) for r in out} == {(r["doc_id"], r["taken"]) for r in again}


def test_mix_over_several_levels(spark):
    rng = random.Random(6)
    docs = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", None, "d"]) if i else "tiny") for i in range(5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = cube_mix.mix_sources(frame, block=20, carry=["source"]).collect()
    _check_mix(docs, out, 0.001)
    rows = cube_mix.mixed_rows(cube_mix.mix_sources(frame, block=20)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in rows} == {r["doc_id"]: r["copies"] for r in out if r["copies"]}


def test_flight_is_balanced():
    rng = random.Random(1)
    size, chance = [rng.randint(0, 50) * 1.0 for _ in range(400)], [rng.random() for _ in range(400)]
    moved = cube_mix.flight(size, chance, rng)
    assert sum(1e-9 < p < 1 - 1e-9 for p in moved) <= 2
    assert abs(sum(moved) - sum(chance)) < 1e-6 and abs(sum(s * p for s, p in zip(size, moved, strict=True)) - sum(s * p for s, p in zip(size, chance, strict=True))) < 1e-5
    size, chance = [5, 3, 9, 2, 2], [0.3, 0.6, 0.5, 0.2, 0.9]
    mean = np.mean([cube_mix.flight(size, chance, random.Random(s)) for s in range(4000)], axis=0)
    assert abs(mean - chance).max() < 0.03
    landed = cube_mix.landing([5, 3, 9], [1.0, 0.5, 0.9], rng)
    assert landed == [1.0, 0.0, 1.0]


def test_mix_of_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("taken", F.lit("clash"))
    out = cube_mix.mix_sources(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    _check_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], rows, 0.05)
    assert cube_mix.mix_sources(empty_documents(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["root"] for r in chosen_path.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert chosen_path.components(spark.createDataFrame([], "a long, b long")).count() == 0

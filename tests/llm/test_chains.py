"""Chains of near copies in buckets that the search thins out."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from prefixlake.llm import chosen_path


def _groups(spark, sets: list, buckets: int, small: int = 2) -> list[set]:
    rows = [(i, bytearray(s.tobytes()), list(range(buckets))) for i, s in enumerate(sets)]
    reps = spark.createDataFrame(rows, "rep long, tokens binary, buckets array<long>")
    found = defaultdict(set)
    for r in chosen_path.candidate_groups(reps, small=small).collect():
        found[r["root"]].add(r["node"])
    return list(found.values())


def test_partners_of_sets_that_leave_a_bucket_are_joined(spark):
    """P-X at 116 of 128 tokens, X-Y at 85: X leaves, so Y, with 73 tokens of P, must be joined to P; Z has nothing in common."""
    p = np.arange(chosen_path.TOKENS, dtype=np.uint16)
    x, y = p.copy(), p.copy()
    x[:12] += 1000
    y[:55] += 1000
    y[12:55] += 1000
    assert (x == p).mean() >= chosen_path.SAME and (x == y).mean() >= chosen_path.LIKELY > (y == p).mean()
    sets = [p, x, y, p + np.uint16(5000)]
    assert _groups(spark, sets, buckets=1) == [{0, 1, 2}]


def test_a_joined_set_stays_for_its_partner_far_from_the_pivot(spark):
    """P-X at 77 of 128 tokens are joined; Y has 36 tokens of P but 87 of X, so X must meet it in a later bucket; Z has nothing in common."""
    p = np.arange(chosen_path.TOKENS, dtype=np.uint16)
    x = p.copy()
    x[:51] += 1000
    y = x.copy()
    y[51:92] += 2000
    assert (x == p).mean() >= chosen_path.NEAR > (y == p).mean() and (x == y).mean() >= chosen_path.LIKELY
    assert _groups(spark, [p, x, y, p + np.uint16(5000)], buckets=48) == [{0, 1, 2}]


def test_a_group_of_near_copies_is_not_split_again(spark, monkeypatch):
    """All sets near the pivot: the pairs with it are tested once for all buckets, and nothing goes on."""
    rng, base, sets = np.random.default_rng(3), np.arange(chosen_path.TOKENS, dtype=np.uint16), []
    for _ in range(200):
        s = base.copy()
        s[rng.choice(chosen_path.TOKENS, 14, replace=False)] += rng.integers(1000, 60000, 14).astype(np.uint16)
        sets.append(s)

    def refuse(threshold):
        def run(batches):
            for batch in batches:
                assert not batch.num_rows
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "far": pa.array([], pa.bool_())})

        return run

    monkeypatch.setattr(chosen_path, "_split", refuse)
    assert _groups(spark, sets, buckets=16, small=64) == [set(range(200))]


def test_hot_names_meet_their_rows_by_broadcast(spark, monkeypatch):
    """A text that a third of the rows share, long ones too: every name is found, hot or not, and rows without one stay."""
    from prefixlake.llm import block_names
    from prefixlake.llm.common import stored

    monkeypatch.setattr(block_names, "HOT_LEAST", 3)
    texts = ["Copy " + "x" * 5000] * 40 + [f"text {i % 25}" for i in range(60)] + [f"Alone {i}" for i in range(20)] + [None, "", "COPY " + "X" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in block_names.exact_copies(docs, carry=[]).collect()}
    lower = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    groups = {t: [i for i, u in enumerate(lower) if u == t] for t in set(lower)}
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in enumerate(lower)}
    names = stored(spark.createDataFrame([("a", 100, 1), ("b", 2, 2)], "k string, many long, name int"))
    rows = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 100), ("b", 101), ("c", 102), (None, 103)], "k string, i int")
    out = block_names.joined(rows, names, ["k"], "many").collect()
    assert {(r["i"], r["name"]) for r in out} == {(i, 1) for i in range(100)} | {(100, 2), (101, 2), (102, None), (103, None)} and len(out) == 104


def test_a_set_is_split_once_for_all_its_buckets():
    """One row a set comes out, with the children of all its buckets; each child keeps its bucket's mark."""
    rng, buckets = np.random.default_rng(4), [[11, 22, 33], [22], []]
    tokens = rng.integers(0, 60000, (3, chosen_path.TOKENS)).astype(np.uint16)
    held = pa.array([[{"bucket": b, "far": b == 22} for b in x] for x in buckets], pa.list_(pa.struct([("bucket", pa.int64()), ("far", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([t.tobytes() for t in tokens], pa.binary()), held], names=["rep", "tokens", "held"])
    (out,) = chosen_path._split(0.05)([batch])
    assert out.column("rep").to_pylist() == [5, 6, 7]
    for i, children in enumerate(out.column("children").to_pylist()):
        want = set()
        for b in buckets[i]:
            path = np.array([b], dtype=np.uint64)
            _, place = chosen_path.chosen(path, 0.05)
            want |= {(int(c), b == 22) for c in chosen_path._child(path, place, tokens[i, place]).view(np.int64)}
        assert {(c["bucket"], c["far"]) for c in children} == want and len(children) == len(want)
        assert not buckets[i] or children


def test_rows_that_go_on_grow_with_the_sets_of_a_group_not_with_their_square(spark, monkeypatch):
    """All sets share a third of their tokens, so they stay in large buckets without being partners."""
    rng, stored, made = np.random.default_rng(5), chosen_path.stored, []
    sets = rng.integers(0, 60000, (160, chosen_path.TOKENS)).astype(np.uint16)
    sets[:, :43] = np.arange(43)

    def counted(df):
        out = stored(df)
        if out.columns == ["bucket", "rep", "far"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "stored", counted)
    totals = []
    for n in (80, 160):
        made.clear()
        assert not any(len(g) > 1 for g in _groups(spark, list(sets[:n]), buckets=20, small=8))
        totals.append(sum(made))
    assert 0 < totals[0] < totals[1] <= 2.5 * totals[0]

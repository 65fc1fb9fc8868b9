import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixlake.llm import line_dedup, queries, source_divergence, token_alignment
from tests.llm.helpers import SF, awkward_documents, empty_documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- source divergence


def _plain_divergence(rows: list, min_docs: int, top: int) -> set:
    terms = [((r["lang"] or ""), (r["source"] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r["text"] or "").translate(UPPER))) for r in rows]
    out = set()
    for lang in {t[0] for t in terms}:
        docs, groups = Counter(), defaultdict(Counter)
        for l, s, words in terms:
            if l == lang:
                docs.update(set(words))
                groups[s].update(words)
        kept = sorted(t for t, n in docs.items() if n >= min_docs)

        def shares(c, kept=kept):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            best = sorted((-(p[s][t] - q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(best)}
    return out


def _divergence(df) -> list:
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]


def test_divergence_equals_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = _divergence(queries.op11_source_divergence(spark, SF))
    assert len(got) == len(set(got)) and set(got) == _plain_divergence(docs.collect(), 30, 50)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_divergence_of_awkward_rows(spark, monkeypatch, min_docs):
    docs = awkward_documents(spark).withColumn("term", F.lit("clash")).withColumn("value", F.lit(1))
    want = _plain_divergence(docs.collect(), min_docs, 4)
    assert set(_divergence(source_divergence.divergence(docs, min_docs=min_docs, top=4))) == want
    monkeypatch.setattr(source_divergence, "CELLS", (3, 3))  # many shards
    monkeypatch.setattr(source_divergence, "HELD", 2)
    assert set(_divergence(source_divergence.divergence(docs, min_docs=min_docs, top=4))) == want


def test_divergence_of_an_empty_table(spark):
    assert source_divergence.divergence(empty_documents(spark)).count() == 0


def test_shares_are_exact():
    for total, terms in ((0, 1), (7, 3), (10**9 + 7, 12345), (2**52, 1000)):
        counts = [c for c in (0, 1, 2, total // 3, total // 2, total) if c <= total]
        got = source_divergence.share(np.array(counts), total, terms).tolist()
        assert got == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


# ---- line deduplication


def _plain_lines(rows: list, min_docs: int, keep_first: bool) -> list:
    docs, first = Counter(), {}
    order = lambda d, i: (d is None, d or 0, i)
    split = [(r["doc_id"], (r["text"] or "").split("\n")) for r in rows]
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(UPPER) for x in lines] for _, lines in split]
    for (d, _), ks in zip(split, keys, strict=True):
        docs.update(set(ks) - {""})
        for i, k in enumerate(ks):
            if k not in first or order(d, i) < order(*first[k]):
                first[k] = (d, i)
    out = []
    for (d, lines), ks in zip(split, keys, strict=True):
        gone = [docs[k] >= min_docs and not (keep_first and first[k] == (d, i)) for i, k in enumerate(ks)]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


def _lines(df) -> list:
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=str)


def test_line_query_equals_plain_counts(spark):
    want = _plain_lines(spark.read.parquet(f"{SF}/documents.parquet").collect(), 10, False)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op12_line_dedup(spark, SF).collect()), key=str)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in want), key=str)


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("limit", [0, 1000])
def test_lines_of_awkward_rows(spark, monkeypatch, keep_first, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)  # 0: the way without a broadcast
    rows = [(1, "Home\n\nA b\tc \nx"), (2, " home \nx\ny"), (3, "HOME\r\nhome\nÉ"), (4, "é\nE"), (None, "x\n\x0bhome"), (None, None), (5, ""), (5, "tail\n"), (6, "tail"), (6, "tail"), (7, "\n" * 2000 + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("line", F.lit(2)).withColumn("digest", F.lit("clash"))
    for table in (docs, awkward_documents(spark)):
        out = line_dedup.dedup_lines(table, min_docs=2, keep_first=keep_first)
        assert _lines(out) == _plain_lines(table.collect(), 2, keep_first)
        assert out.columns == [*table.drop("kept").columns, "n_lines", "n_dropped", "kept"]
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_full_filters_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(7)
    want = _plain_lines(docs.collect(), 3, True)
    monkeypatch.setattr(line_dedup, "HELD", 50)
    assert _lines(line_dedup.dedup_lines(docs, min_docs=3)) == want
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 64)
    assert _lines(line_dedup.dedup_lines(docs, min_docs=3)) == want


def test_filters_suspect_every_repeat():
    rng = np.random.default_rng(5)
    filters, seen = line_dedup.Filters(1 << 10), Counter()
    for _ in range(30):
        hashes = np.unique(rng.integers(0, 400, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more = hashes[::9]
        once = np.setdiff1d(hashes, more)
        filters.add(once, more)
        seen.update(once.tolist())
        seen.update(more.tolist() * 2)
    a, b = line_dedup._places(np.array(list(seen), dtype=np.uint64), 1 << 10)
    again = filters.twice[a] & filters.twice[b]
    assert all(s for s, n in zip(again, seen.values(), strict=True) if n > 1)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(None, min_docs=1)


# ---- token alignment


@pytest.fixture(scope="module")
def tables():
    return token_alignment.Tokens(*[token_alignment.token_file(f) for f in (token_alignment.TOKENIZER_A, token_alignment.RANKS_A, token_alignment.TOKENIZER_B)])


def _plain_tokens(tables, text: str | None) -> tuple[list[int], list[int]]:
    if not text:
        return [], []
    a, b = tables.a.encode(" " + text, add_special_tokens=False).ids, tables.b.encode(text)
    want = (" " + text).encode()
    same = b"".join(tables.a_bytes[i] for i in a) == want == b"".join(tables.b_bytes[i] for i in b)
    return (a, b) if same else ([], [])


def _plain_alignment(tables, texts: list) -> list[tuple]:
    alone, held = [], Counter()
    for text in texts:
        a, b = _plain_tokens(tables, text)
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, tables.a_bytes), (b, tables.b_bytes))]
        after = [{e: k + 1 for k, e in enumerate(x)} for x in ends]
        groups, links, i, j = [], Counter(), 0, 0
        for stop in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = after[0][stop], after[1][stop]
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            for x in range(i, i2):
                for y in range(j, j2):
                    if ends[0][x] > ends[1][y] - len(tables.b_bytes[b[y]]) and ends[1][y] > ends[0][x] - len(tables.a_bytes[a[x]]):
                        links[a[x], b[y]] += 1
            i, j = i2, j2
        assert (i, j) == (len(a), len(b))
        held.update(links.keys())
        alone.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(na, nb, len(g), sum(k.values()), sum(n for p, n in k.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in k.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, k in alone]


def test_chunks_do_not_change_tokens(tables):
    rng = random.Random(2)
    parts = ["a", "the", "ing", " ", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "▁", "1", "12", "'s", "'", "...", "\x00", "\x1c", "<s>", "<|endoftext|>", "<0x0A>", "日本", "　", "\xa0", "\x85", "😀", "!!", "​", "ﬁ", "ß", "Ж", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for t in texts:
        rows = tables.look_up(token_alignment.chunks_of_text(t))
        a, b = _plain_tokens(tables, t)
        if tables.spelt[rows].all():
            assert tables.tokens(0, rows)[0].tolist() == a and tables.tokens(1, rows)[0].tolist() == b, repr(t)
        else:
            assert not a and not b and "▁" in t, repr(t)


def test_alignment_query_equals_plain_alignment(spark, tables):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], _plain_alignment(tables, [r["text"] for r in rows]), strict=True))
    got = queries.op13_token_alignment(spark, SF)
    assert {r["doc_id"]: tuple(r[c] for c in token_alignment._NAMES) for r in got.collect()} == want


@pytest.mark.parametrize("limit", [0, 10**6])
def test_alignment_of_awkward_rows(spark, tables, monkeypatch, limit):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", limit)
    more = [(20, "▁a b", "x", "s", 1, "y"), (21, "日本語 テキスト <s> <|endoftext|>", "x", "s", 1, "y"), (22, " " * 9 + "x ", "x", "s", 1, "y")]
    docs = awkward_documents(spark).union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, size int, shard string"))
    docs = docs.withColumn("n_a", F.lit("clash")).withColumn("pair", F.lit("clash")).withColumn("times", F.lit(1)).withColumn("best", F.lit(1))
    texts = [r["text"] for r in docs.collect()]
    out = token_alignment.align_documents(docs)
    rows = out.collect()
    assert sorted(tuple(r[c] for c in token_alignment._NAMES) for r in rows) == sorted(_plain_alignment(tables, texts))
    for r in rows:
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_groups"] else "")
    assert token_alignment.align_documents(empty_documents(spark)).count() == 0


def test_slices_and_full_tables_change_nothing(tables, monkeypatch):
    texts = [" ".join(f"w{i * j % 101}é" for j in range(50)) for i in range(40)] + [None, "", "a ▁ b", "z" * 5000]
    whole = token_alignment.align_batch(tables, texts, True)
    monkeypatch.setattr(token_alignment, "SLICE", 7)
    monkeypatch.setattr(token_alignment, "TABLE_ENTRIES", 30)
    tables.clear()
    small = token_alignment.align_batch(tables, texts, True)
    assert ["".join(t) for t in whole.texts] == ["".join(t) for t in small.texts]
    assert [h.hexdigest() for h in whole.digest] == [h.hexdigest() for h in small.digest]
    assert (whole.sums == small.sums).all() and all((x == y).all() for x, y in zip(whole.pairs(), small.pairs(), strict=True))

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixlake.llm import byte_cnn, chunk_tokens, html_cut, langid, licence_scan, queries
from prefixlake.llm.words import shingle_sets
from tests.llm.helpers import SF, awkward_documents, crc, empty_documents, plain_shingles


def test_language_query_matches_plain_naive_bayes(spark):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in rows)
    train = [r for r in rows if crc(r["doc_id"]) % 4 != 2 and r["lang"] is not None and r["text"] is not None]
    names = sorted({r["lang"] for r in train})
    size = 1 << langid.BITS
    counts, prior = np.zeros((len(names), size)), np.zeros(len(names))
    for r in train:
        prior[names.index(r["lang"])] += 1
        for buckets, _ in langid.ngram_buckets([r["text"]]):
            counts[names.index(r["lang"])] += np.bincount(buckets, minlength=size)
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * size))
    right = 0
    for r in rows[:120]:
        total = np.log(prior / prior.sum())
        for buckets, _ in langid.ngram_buckets([r["text"]]):
            total = total + logs[:, buckets].sum(axis=1)
        assert got[r["doc_id"]]["lang_pred"] == names[int(total.argmax())]
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right >= 0.97 * len(held)


def test_ngrams_do_not_cross_texts():
    texts = ["abc", "", "é b", "xyz" * 50]
    for k, (buckets, starts) in enumerate(langid.ngram_buckets(texts)):
        ends = [*starts[1:], len(buckets)]
        for t, a, b in zip(texts, starts, ends, strict=True):
            alone = list(langid.ngram_buckets([t]))[k][0]
            assert alone.tolist() == buckets[a:b].tolist()


def test_language_of_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("score", F.lit("clash"))
    out = langid.predict(docs, langid.fit(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and (letters or r["score"] == 0)
    assert langid.fit(empty_documents(spark)) is None
    assert langid.predict(empty_documents(spark), None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_tokens_equal_the_library(spark):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=chunk_tokens.model_path())
    got = {r["doc_id"]: r for r in queries.op5_piece_tokens(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = pieces.encode(r["text"] or "", add_eos=True)
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()


def test_tokens_of_awkward_texts(spark):
    import random

    table = chunk_tokens.ChunkTable(chunk_tokens.model_path())
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "   ", "\n", "\t", "é", "▁", "1", "\x00", "<s>", "</s>", "<0x0A>", "日本", "　", "\xa0", "😀", "!!", "​", "�", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "  ", "▁", "a ", " a"]
    for t, (ids, decoded) in zip(texts, table.encode(texts), strict=True):
        want = table.pieces.encode(t, add_eos=True)
        assert ids == " ".join(map(str, want)) and decoded == table.pieces.decode(want), t
    docs = awkward_documents(spark).withColumn("decoded", F.lit(1))
    out = chunk_tokens.encode_documents(docs).collect()
    assert len(out) == docs.count()
    assert all(r["n_tokens"] == len(r["token_ids"]) and r["decoded"] == (r["text"] or "") for r in out)
    assert [r["token_ids"] for r in out if not r["text"]] == [[2]] * 3
    assert chunk_tokens.encode_documents(empty_documents(spark)).count() == 0


def test_table_that_is_full_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{i * j % 101}" for j in range(50)) for i in range(40)]
    whole = list(chunk_tokens.ChunkTable(chunk_tokens.model_path()).encode(texts))
    monkeypatch.setattr(chunk_tokens, "TABLE_ENTRIES", 30)
    small = chunk_tokens.ChunkTable(chunk_tokens.model_path())
    assert [x for t in texts for x in small.encode([t])] == whole


def test_quality_is_learned(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in queries.op7_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if crc(r["doc_id"]) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    bad, good = [[got[r["doc_id"]]["score"] for r in held if r["quality"] == q] for q in (0, 1)]
    assert np.mean([b < g for b in bad for g in good]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_network_sees_every_window():
    w = byte_cnn.initial(3)
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (0, 1, 7, 8, 9, 70, 71, 72, 500, 64 * 64 + 7, 9001)]
    together = byte_cnn.score_bytes(w, texts)
    for t, got in zip(texts, together, strict=True):
        data = np.frombuffer(t.ljust(8, b"\0"), dtype=np.uint8)
        e = w["embed"][data]
        acts = [e[i : i + byte_cnn.WIDTH].ravel() @ w["filters"] + w["shift"] for i in range(max(1, len(t) - byte_cnn.WIDTH + 1))]
        pools = [np.maximum(np.max(acts[i : i + byte_cnn.POOL], axis=0), 0) for i in range(0, len(acts), byte_cnn.POOL)]
        hidden = np.array([np.maximum(p @ w["hidden"] + w["lift"], 0) for p in pools])
        z = np.concatenate([hidden.mean(axis=0), hidden.max(axis=0)]) @ w["out"] + w["bias"][0]
        assert abs(1 / (1 + np.exp(-z)) - got) < 1e-5


def test_network_gradient():
    rng = np.random.default_rng(1)
    w = byte_cnn.initial(3)
    length = byte_cnn.padded(150)
    data = rng.integers(0, 256, (3, length)).astype(np.uint8)
    valid = np.ones((3, length - byte_cnn.WIDTH + 1), dtype=bool)
    valid[1, 90:] = False
    y = np.array([0.0, 1.0, 1.0])
    _, g = byte_cnn._step(w, data, valid, y)
    for name in w:
        at = tuple(rng.integers(0, s) for s in w[name].shape) if name != "embed" else (int(data[0, 5]), 1)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (byte_cnn._step(up, data, valid, y)[0] - byte_cnn._step(down, data, valid, y)[0]) / 2e-5
        assert abs(slope - g[name][at]) < 1e-4 + 1e-2 * abs(slope), name


def test_quality_of_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("predicted", F.lit("clash"))
    labelled = docs.withColumn("quality", F.when(F.col("doc_id") > 5, 1).when(F.col("doc_id") > 2, 0))
    weights = byte_cnn.fit(labelled.drop("quality"), labelled.select("doc_id", "quality"))
    out = byte_cnn.score(docs, weights).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert byte_cnn.fit(labelled.drop("quality"), labelled.select("doc_id", "quality").limit(0)) is None
    assert {r["score"] for r in byte_cnn.score(docs, None).collect()} == {0.5}
    assert byte_cnn.score(empty_documents(spark), weights).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var a = "<p>no</p>";</script></head><body class="widget-page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">X</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, accept them all.</p></div><!-- <p>no</p> -->
<main><article id="post"><header><h1>The  title &amp; more</h1></header><p>First <b>bold</b>
paragraph, with <a href="/y">a link</a>.<p>Second&nbsp;one<br>broken.</p><div class="ad">Buy now!</div>
<ul><li>point one</li><li>point two</li></ul><form><label>Mail</label><input><button>Go</button></form><aside>Related: things</aside>
<section class="comments"><h3>Comments</h3><p>I like this article very much, thanks.</p></section></article></main>
<div id="sidebar">Popular posts</div><footer>&copy; us</footer></body></html>"""
TEXT = "The title & more\n\nFirst bold paragraph, with a link.\n\nSecond one broken.\n\npoint one\n\npoint two"


@pytest.mark.parametrize("weights", [None, html_cut.PRIOR])
def test_main_text_of_a_page(spark, weights):
    if weights is None:
        weights = html_cut.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    assert html_cut.main_text(PAGE, weights)[0] == TEXT


def test_main_text_query(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op8_main_text(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        want = "\n\n".join(x for x in parts if x)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_minimum_cut_is_minimal():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 9)
        content, boiler = (np.array([round(rng.random() * 3, 2) for _ in range(n)]) for _ in range(2))
        edges = [(i, j, round(rng.random() * 2, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def cost(label):
            return sum(content[i] if x else boiler[i] for i, x in enumerate(label)) + sum(c for i, j, c in edges if label[i] != label[j])

        best = min(cost(x) for x in itertools.product((0, 1), repeat=n))
        assert abs(cost(html_cut.minimum_cut(content, boiler, edges)) - best) < 1e-9


def test_awkward_pages(spark):
    pages = ["", None, "<", "<p", "plain text", "<script>x", "<!-- open", "<p>a<p>b", "</div></p>", "<a title='x>y'>link</a>", "<article>" * 2000 + "deep", "&#0;&bogus;&amp", "<article><p>same</p></article>", "<article><p>same</p></article>"]
    df = spark.createDataFrame([(i if i else None, h, "clash") for i, h in enumerate(pages)], "page_id long, html string, text string")
    out = html_cut.extract(df, html_cut.fit(df)).collect()
    assert len(out) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] in (12, 13)] == ["same", "same"]
    assert html_cut.extract(df.limit(0), html_cut.fit(df.limit(0))).count() == 0


def test_licences_are_found(spark):
    import re

    got = queries.op3_licence_scan(spark, SF.replace("0.001", "0.01")).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    want = set()
    for d, t in texts.items():
        at = 0
        for i, line in enumerate(t.split("\n")):
            if re.search(r"licen|rights reserved", line, re.I):
                want.add((d, i, at, at + len(line)))
            at += len(line) + 1
    assert {(r["doc_id"], r["paragraph"], r["start"], r["end"]) for r in got} == want
    assert all(r["confirmed"] for r in got)


def test_licence_families_and_unknown():
    model = licence_scan.train(["the cat sat on the mat and looked", "he had to renew the permit for his car"])
    for family, templates in licence_scan.TEMPLATES.items():
        for t in templates:
            found = licence_scan.classify(model, [t, t.lower()])
            assert [f[:2] for f in found] == [(0, family), (1, family)] and all(f[3] == 1 for f in found)
    for t in ["", "You need a permission slip.", "The version of the public story", "Software can be free of bugs", "any person"]:
        assert not [f for f in licence_scan.classify(model, [t]) if f[3] >= licence_scan.MIN_COVER], t


def test_licences_of_awkward_rows(spark):
    docs = awkward_documents(spark).union(spark.createDataFrame([(20, "x\nAll rights reserved.\nAll rights reserved.", "en", "a", 1, "q")], awkward_documents(spark).schema))
    out = licence_scan.scan(docs, licence_scan.fit(docs)).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["start"]) for r in out) == [(20, 1, 2), (20, 2, 23)]
    assert licence_scan.scan(empty_documents(spark), licence_scan.fit(empty_documents(spark))).count() == 0


def test_shingles_equal_a_plain_version():
    texts = ["a b c d e f", "", "one", "one two", "A  b, c-d e! f a b c d e", "é à ç — x y z", "word " * 20, "\x00 a", "x_1 y2 z3 q4 r5 s6"]
    sets = shingle_sets(texts)
    for i, a in enumerate(texts):
        assert len(sets[i]) == len(plain_shingles(a)), a
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain_shingles(a) & plain_shingles(b))

from collections import Counter, defaultdict

import corpus_pipeline
from prefixlake.llm import cube_mix, queries
from tests.llm.helpers import SF, awkward_documents, empty_documents
from tests.llm.test_table_operators import _brute_links


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = set(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
        got = Counter(r["doc_id"] for r in out.collect())
        if name == "language_id":
            kept = {d for d in kept if any(map(str.isalpha, rows[d]["text"] or ""))}
        elif name == "exact_dedup":
            last = {}
            for d in sorted(kept):
                last[(rows[d]["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))] = d
            kept = set(last.values())
        elif name == "near_dedup":
            ordered = sorted(kept)
            _, root = _brute_links([(d, rows[d]["text"]) for d in ordered])
            groups = defaultdict(list)
            for d, r in zip(ordered, root, strict=True):
                groups[r].append(d)
            kept = {min(g) for g in groups.values()}
        if name == "mix":
            want = {r["doc_id"]: r["copies"] for r in cube_mix.mix_sources(docs).collect() if r["copies"]}
            assert got == want and set(got) <= kept
        elif name == "tokens":
            assert got == want
        else:
            assert set(got) == kept and max(got.values()) == 1
        out.write.mode("overwrite").parquet(path := f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stage-{k}")
        docs = spark.read.parquet(path)
    assert Counter(r["doc_id"] for r in queries.pipeline(spark, SF).collect()) == want


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (awkward_documents(spark), empty_documents(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert k == 4 or out.columns == docs.columns
            out.collect()

"""Registered queries of vector search and the phrase model."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.functions.text import normalize_text, words
from prefixlake.operators import phrases as G
from prefixlake.operators import dense_index
from prefixlake.operators import vectors as V
from prefixlake.operators.patterns import generated_corpus
from prefixlake.operators.retrieve import semantic_documents, vector_queries
from prefixlake.registry import duck as d
from prefixlake.registry import shared as S
from prefixlake.registry.core import held, query, table
from prefixlake.registry.retrieval import DOC_SQL, near

c = F.col


@query("f1_semantic_documents", d.with_(DOC_SQL, "SELECT doc_id, text FROM docs"))
def f1(spark, sf):
    return semantic_documents(S.catalog(spark, sf)).select("doc_id", "text")


def sparse_ctes(source: str, key: str, out: str) -> list[str]:
    """Unit sparse vectors of ``source``(key, text) as ``out``(key, feature, w)."""
    return [
        f"{out}x AS MATERIALIZED (SELECT {key}, {d.expand_semantic('n')} AS x FROM (SELECT {key}, {d.norm('text')} AS n FROM {source}))",
        f"{out}f AS (SELECT {key}, 'tok:' || t AS feature, CASE WHEN length(t) >= 5 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS w FROM (SELECT {key}, unnest(string_split(x, ' ')) AS t FROM {out}x) WHERE length(t) >= 2 "
        f"UNION ALL SELECT {key}, 'tri:' || unnest({d.grams(d.flat('x'))}), 0.32::DOUBLE FROM {out}x)",
        f"{out}s AS (SELECT {key}, feature, sum(w) AS w FROM {out}f GROUP BY {key}, feature)",
        f"{out} AS MATERIALIZED (SELECT {key}, feature, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {out}s)",
    ]


@query("f2_sparse_index", d.with_(DOC_SQL + sparse_ctes("docs", "doc_id", "ix"), "SELECT doc_id, feature, round(w, 9) AS weight FROM ix"))
def f2(spark, sf):
    return S.index(spark, sf).select("doc_id", "feature", F.round("weight", 9).alias("weight"))


VQ = "vq AS MATERIALIZED (SELECT q, expanded AS text FROM forms WHERE norm <> '' AND NOT (NOT contains(norm, ' ') AND norm = expanded AND len(expansions) = 0 AND length(norm) >= 6))"
KNN = d.form_ctes() + DOC_SQL + [VQ] + sparse_ctes("docs", "doc_id", "ix") + sparse_ctes("vq", "q", "qv") + [
    f"dots AS (SELECT q, doc_id, {d.round3('round(sum(qv.w * ix.w), 12)')} AS similarity FROM qv JOIN ix USING (feature) GROUP BY q, doc_id)",
    "knn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, doc_id) AS rank FROM dots WHERE similarity >= 0.38)",
]


@query("f3_sparse_knn", d.with_(KNN, "SELECT q, doc_id, similarity, rank FROM knn WHERE rank <= 10"))
def f3(spark, sf):
    return near(spark, sf).select("q", "doc_id", "similarity", "rank")


def _units(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.unit(c("embedding")).alias("vec"), "label")


DENSE = [
    "u AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)",
    f"p AS (SELECT a.vec_id AS q_id, b.vec_id, b.label, {d.round3('round(list_cosine_similarity(a.v, b.v), 12)')} AS similarity FROM u a, u b)",
    "k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) AS rank FROM p WHERE similarity > 0)",
]


def _dense(spark, sf):
    def build():
        units = _units(spark, sf)
        return V.dense_knn(units.select(c("vec_id").alias("q_id"), "vec"), units.select("vec_id", "vec"))

    return held(spark, sf, "dense", build)


@query("f4_dense_knn", d.with_(DENSE, "SELECT q_id, vec_id, similarity, rank FROM k WHERE rank <= 10"))
def f4(spark, sf):
    return _dense(spark, sf).select("q_id", "vec_id", "similarity", "rank")


@query("f5_approx_dense_knn")
def f5(spark, sf):
    units = _units(spark, sf)
    return dense_index.approx_dense_knn(units.select(c("vec_id").alias("q_id"), "vec"), units.select("vec_id", "vec")).select("q_id", "vec_id", "similarity", "rank")


@query(
    "f6_vote_intent",
    d.with_(
        DENSE + [
            "v AS (SELECT q_id, label, sum(similarity) AS s, min(rank) AS f FROM k WHERE rank <= 8 GROUP BY q_id, label)",
            "t AS (SELECT q_id, arg_min(label, [-round(s, 9), f]) AS label, max(s) AS s, sum(s) AS total FROM v GROUP BY q_id)",
        ],
        f"SELECT q_id, CAST(label AS VARCHAR) AS type, {d.round3('round(least(0.88::DOUBLE, greatest(0.42::DOUBLE, s / total)), 9)')} AS confidence FROM t",
    ),
)
def f6(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", c("label").cast("string").alias("intent"))
    voted = V.vote_intent(_dense(spark, sf).join(labels, "vec_id").withColumnRenamed("q_id", "q"))
    return voted.select(c("q").alias("q_id"), "type", "confidence")


@query("f7_gate_vector_queries", d.with_(d.form_ctes() + [VQ], "SELECT q, text AS query FROM vq"))
def f7(spark, sf):
    return vector_queries(S.forms(spark, sf)).select("q", "query")


CORPUS = d.inputs("pairs", "popular", "pois") + [
    f"pc AS (SELECT suggestion_text AS text, suggestion_type AS type, 'autocomplete' AS source, {d.clamp01('query_frequency / 15000.0::DOUBLE')} AS freq, 0.96::DOUBLE AS weight, 0 AS g, row_ord FROM in_pairs "
    f"UNION ALL SELECT query_text, intent_type, 'popular-query', {d.clamp01('monthly_frequency / 15000.0::DOUBLE')}, 0.9::DOUBLE, 1, row_ord FROM in_popular "
    f"UNION ALL SELECT poi_name, CASE WHEN {d.has_any(d.norm('category'), ['atm', 'benh vien', 'cay xang'])} THEN 'Nearby Search' ELSE 'POI Search' END, 'poi', {d.clamp01('popularity_score / 100.0::DOUBLE')}, 0.82::DOUBLE, 2, row_ord FROM in_pois)",
    f"ph AS MATERIALIZED (SELECT *, {d.words('norm')} AS w FROM (SELECT *, {d.norm('text')} AS norm FROM pc) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY freq + weight DESC, g, row_ord) = 1)",
]


def _corpus(spark, sf):
    return held(spark, sf, "corpus", lambda: G.phrase_corpus(S.catalog(spark, sf)))


@query("g1_phrase_corpus", d.with_(CORPUS, "SELECT norm, text, type, source, round(freq, 9) AS freq, weight FROM ph"))
def g1(spark, sf):
    return _corpus(spark, sf).select("norm", "text", "type", "source", F.round("freq", 9).alias("freq"), "weight")


def _doc_phrases(spark, sf):
    """Whole documents as phrases, plus the corpus."""
    return table(spark, sf, "benchmark").select(F.concat(F.lit("b"), c("item_id").cast("string")).alias("phrase_id"), words(normalize_text(c("text"))).alias("words")).unionByName(
        _corpus(spark, sf).select("phrase_id", "words")
    )


LINES = CORPUS + [f"ln AS MATERIALIZED (SELECT w FROM ph UNION ALL SELECT {d.words(d.norm('text'))} FROM benchmark)"]


@query(
    "g2_prefix_counts",
    d.with_(
        LINES + ["x AS (SELECT array_to_string(w[:i], ' ') AS prefix, i = len(w) AS last FROM (SELECT w, unnest(range(0, len(w) + 1)) AS i FROM ln))"],
        "SELECT prefix, count(*) AS n, CAST(sum(CASE WHEN last THEN 1 ELSE 0 END) AS BIGINT) AS n_terminal FROM x GROUP BY prefix",
    ),
)
def g2(spark, sf):
    return G.prefix_counts(_doc_phrases(spark, sf))


MOVES = LINES + [
    "pd AS (SELECT list_concat(['<s>', '<s>'], list_append(w, '</s>')) AS p FROM ln)",
    "mv AS (SELECT p[i] || ' ' || p[i + 1] AS context, p[i + 2] AS next, count(*) AS n FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM pd) GROUP BY ALL)",
]


@query("g3_transitions", d.with_(MOVES, "SELECT context, next, n, round(n / sum(n) OVER (PARTITION BY context), 9) AS p FROM mv"))
def g3(spark, sf):
    return G.transitions(_doc_phrases(spark, sf)).select("context", "next", "n", F.round("p", 9).alias("p"))


@query("g4_complete_phrases")
def g4(spark, sf):
    done = held(spark, sf, "g4", lambda: G.complete_phrases(S.forms(spark, sf), S.phrases(spark, sf)))
    return done.select("q", "rank", "text", "type", "confidence", "base")


@query(
    "g5_suffix_score",
    d.with_(
        CORPUS + [
            "pd AS (SELECT list_concat(['<s>', '<s>'], list_append(w, '</s>')) AS p FROM ph)",
            "mv AS (SELECT p[i] || ' ' || p[i + 1] AS context, p[i + 2] AS next, count(*) AS n FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM pd) GROUP BY ALL)",
            "pr AS MATERIALIZED (SELECT context, next, n / sum(n) OVER (PARTITION BY context) AS p FROM mv)",
            "t AS (SELECT norm, w, list_concat(['<s>', '<s>'], w) AS ctx FROM ph WHERE len(w) >= 2)",
            "st AS (SELECT norm, i, ctx[i + 2] || ' ' || ctx[i + 3] AS context, w[i + 2] AS next FROM (SELECT *, unnest(range(0, least(4, len(w) - 1))) AS i FROM t))",
        ],
        "SELECT norm, round(avg(coalesce(p, 0)), 9) AS ngram FROM st LEFT JOIN pr USING (context, next) GROUP BY norm",
    ),
)
def g5(spark, sf):
    corpus = _corpus(spark, sf)
    pairs = corpus.filter("size(words) >= 2").select(F.get("words", F.lit(0)).alias("variant"), "norm", F.slice("words", 1, 1).alias("q_words"), "words")
    return G.suffix_score(pairs, G.transitions(corpus)).select("norm", F.round("ngram", 9).alias("ngram"))


@query("g6_generated_corpus")
def g6(spark, sf):
    return generated_corpus(S.catalog(spark, sf)).select("id", "text", "type", F.concat_ws("|", "matched").alias("matched"), "base", "freq")

"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.llm import block_names, byte_cnn, chosen_path, chunk_tokens, cube_mix, histogram_shards, html_cut, impact_search, langid, licence_scan, line_dedup, source_divergence, token_alignment
from prefixlake.llm.common import crc_slice, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_slice("doc_id", 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_shards.shard_documents(docs, shards=40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return licence_scan.scan(docs, licence_scan.fit(docs))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return impact_search.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op5_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_tokens.encode_documents(docs, tokens=False).drop("text")


def op6_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_copies(read_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=[])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_slice("doc_id", 3) == 1
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    weights = byte_cnn.fit(docs.filter(~held_out), labels.filter(~held_out))
    return byte_cnn.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_cut.extract(pages, html_cut.fit(pages)).select("page_id", "url", "text", "n_chars", "n_blocks", "n_content")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chosen_path.jaccard_join(docs).drop("text")


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return cube_mix.mix_sources(docs, carry=[])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(read_table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_documents(docs, groups=False).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_language_id, op2_histogram_shards, op3_licence_scan, op4_exact_top_k, op5_piece_tokens, op6_block_names, op7_quality, op8_main_text, op9_jaccard_join, op10_cube_mix, op11_source_divergence, op12_line_dedup, op13_token_alignment, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_top_k": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
                FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
            )
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
        "op6_block_names": """
            WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t""",
        "op11_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
            k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
            g AS (SELECT DISTINCT lang, source FROM d),
            c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
            cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS ln FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
            p AS (SELECT lang, source, term, n,
                    1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
                    1 + (CAST(1000000000 AS HUGEINT) * (ln + 5)) // (sum(ln) OVER s + 5 * count(*) OVER s) AS q
                FROM cells WINDOW s AS (PARTITION BY lang, source)),
            pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            every AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
                FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source)
            SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
            UNION ALL
            SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank
            FROM p WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= 50""",
        "op12_line_dedup": r"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
            l AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
            k AS (SELECT r, doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
            SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
            FROM k LEFT JOIN often ON k.key = often.key GROUP BY r, doc_id""",
    }

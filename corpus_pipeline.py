"""The corpus pipeline: documents of a known language, each text once, near copies thinned, sources mixed, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. A stage that begins deletes the tables that the stages
before it stored: their results are written, and nothing else may be read from them any more.

Defined results of every stage: null texts count as empty, and only the first stage drops them
(they have no language); texts are never cut, however long; rows that repeat a doc_id are decided
one by one; ties go by the id (the largest stays among equal texts, the smallest among near
copies) and by the row where ids are equal; an empty table gives an empty result; extra columns
pass through all stages but the last, also under the name of a result of an operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.llm import block_names, chosen_path, chunk_tokens, cube_mix, langid
from prefixlake.llm.common import crc_slice, prepare, release
from prefixlake.session import checkpoint_folder


def _begin(spark: SparkSession) -> None:
    prepare(spark)
    release(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter."""
    _begin(spark)
    model = langid.fit(docs.filter(crc_slice("doc_id", 4) != 2))
    return langid.predict(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the largest id."""
    _begin(spark)
    return block_names.exact_copies(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, keep the row with the smallest id."""
    _begin(spark)
    return chosen_path.jaccard_join(docs).filter("stays").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    _begin(spark)
    return cube_mix.mixed_rows(cube_mix.mix_sources(docs)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoded text as digests, with the id of each document."""
    _begin(spark)
    return chunk_tokens.encode_documents(docs.select("doc_id", "text"), tokens=False).drop("text")


STAGES = [("language_id", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokenize)]
#: No SQL states trained predictions, balanced random choices or token ids; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs

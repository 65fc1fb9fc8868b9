"""Writers for models, vectors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.operators.phrases import PhraseModel


def write_phrase_model(model: PhraseModel, path: str) -> None:
    model.phrases.write.mode("overwrite").parquet(f"{path}/phrases")
    model.transitions.write.mode("overwrite").parquet(f"{path}/transitions")


def read_phrase_model(spark: SparkSession, path: str) -> PhraseModel:
    return PhraseModel(spark.read.parquet(f"{path}/phrases"), spark.read.parquet(f"{path}/transitions"))


def bad_vectors(df: DataFrame, dims: int) -> DataFrame:
    """Rows without an id or kind, with a wrong size, or with a value that is not finite."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != "") & (F.size("vector") == dims) & finite
    return df.filter(~F.coalesce(fine, F.lit(False)))


def write_embeddings(df: DataFrame, path: str, dims: int) -> None:
    if not bad_vectors(df, dims).isEmpty():
        raise ValueError(f"embedding rows must have id, kind and {dims} finite values")
    df.write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, dims: int) -> DataFrame:
    df = spark.read.parquet(path)
    if not bad_vectors(df, dims).isEmpty():
        raise ValueError(f"{path} holds malformed embedding rows")
    return df


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, in parts as the rows come."""
    df.write.mode("overwrite").json(path)


def write_weights(spark: SparkSession, weights: dict[str, float], path: str) -> None:
    """Ranking weights as a one-row JSON config."""
    columns = ", ".join(f"{name} double" for name in weights)
    spark.createDataFrame([tuple(weights.values())], columns).coalesce(1).write.mode("overwrite").json(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, float]:
    row = spark.read.json(path).first().asDict()
    total = sum(max(0.0, float(v)) for v in row.values())
    return {k: max(0.0, float(v)) / total for k, v in row.items()}

"""The five catalog tables a suggestion job reads, as one bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.sources.tables import search_input


@dataclass(frozen=True)
class Catalog:
    pairs: DataFrame
    pois: DataFrame
    popular: DataFrame
    abbreviations: DataFrame
    eval_cases: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.pairs.sparkSession

    def row_counts(self) -> DataFrame:
        """One row per table with its number of rows."""
        named = [
            ("autocomplete", self.pairs), ("pois", self.pois),
            ("abbreviations", self.abbreviations), ("popularQueries", self.popular),
        ]
        if self.eval_cases is not None:
            named.append(("evaluationCases", self.eval_cases))
        counts = [
            df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, df in named
        ]
        out = counts[0]
        for other in counts[1:]:
            out = out.unionByName(other)
        return out


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(
        pairs=search_input(spark, sf_dir, "pairs"),
        pois=search_input(spark, sf_dir, "pois"),
        popular=search_input(spark, sf_dir, "popular"),
        abbreviations=search_input(spark, sf_dir, "abbreviations"),
    )

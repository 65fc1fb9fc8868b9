"""Registration of named queries and their check SQL, and shared stages per session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefixlake.session import hold, tune
from prefixlake.sources.tables import search_input, star_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STAGES: dict[tuple, object] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement over the same tables."""
    def register(fn: Query) -> Query:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = call
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]) -> object:
    """A result several queries start from, worked out once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def held(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return stage(spark, sf_dir, name, lambda: hold(build()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return star_table(spark, sf_dir, name)


def inp(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return search_input(spark, sf_dir, name)

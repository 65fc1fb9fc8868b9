"""Stages that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.aliases import empty_memory, upsert_aliases
from prefixlake.operators.entities import extract_entities
from prefixlake.operators.lexicon import Lexicon, build_lexicon
from prefixlake.operators.phrases import PhraseModel
from prefixlake.operators.retrieve import semantic_documents
from prefixlake.operators.understand import expand_queries, understand
from prefixlake.operators.vectors import sparse_index
from prefixlake.plans.suggest import SearchModel, Suggested, build_model, build_phrases, run
from prefixlake.registry.core import held, inp, stage
from prefixlake.session import hold, side_by_side
from prefixlake.sources.catalog import Catalog


def catalog(spark, sf) -> Catalog:
    """The derived catalog, written once per session to the shared folder."""
    def build() -> Catalog:
        names = ("pairs", "pois", "popular", "abbreviations")
        tables = side_by_side(*[lambda n=n: held(spark, sf, f"in_{n}", lambda: inp(spark, sf, n)) for n in names])
        return Catalog(**dict(zip(names, tables, strict=True)))

    return stage(spark, sf, "catalog", build)


def requests(spark, sf) -> DataFrame:
    return held(spark, sf, "requests", lambda: inp(spark, sf, "requests"))


def forms(spark, sf) -> DataFrame:
    """Distinct queries after expansion only."""
    return held(spark, sf, "forms", lambda: expand_queries(requests(spark, sf), catalog(spark, sf).abbreviations))


def contexts(spark, sf) -> DataFrame:
    """Distinct request contexts with the expanded query: request_id, city, lat, lon, now, q, ..."""
    def build() -> DataFrame:
        keyed = requests(spark, sf).groupBy("q", "city", "lat", "lon", "now").agg(F.min("request_id").alias("request_id"))
        return keyed.join(forms(spark, sf), "q")

    return held(spark, sf, "contexts", build)


def lexicon(spark, sf) -> Lexicon:
    return stage(spark, sf, "lexicon", lambda: build_lexicon(catalog(spark, sf)))


def understood(spark, sf) -> DataFrame:
    return held(spark, sf, "understood", lambda: understand(requests(spark, sf), lexicon(spark, sf), catalog(spark, sf).abbreviations))


def entities(spark, sf) -> DataFrame:
    """Entities of the expanded queries."""
    return held(spark, sf, "entities", lambda: extract_entities(forms(spark, sf), catalog(spark, sf)))


def documents(spark, sf) -> DataFrame:
    return held(spark, sf, "docs", lambda: semantic_documents(catalog(spark, sf)))


def index(spark, sf) -> DataFrame:
    """The sparse index of the documents, without the rest of the model."""
    return held(spark, sf, "index", lambda: sparse_index(documents(spark, sf)))


def phrases(spark, sf) -> PhraseModel:
    """The phrase model, without documents and their index."""
    return stage(spark, sf, "phrases", lambda: build_phrases(catalog(spark, sf)))


def model(spark, sf) -> SearchModel:
    def build() -> SearchModel:
        cat = catalog(spark, sf)
        found, known, words = side_by_side(lambda: index(spark, sf), lambda: phrases(spark, sf), lambda: lexicon(spark, sf))
        return build_model(cat, documents(spark, sf), found, known, words)

    return stage(spark, sf, "model", build)


def suggested(spark, sf) -> Suggested:
    """One full run over all requests: known users get their history, weak queries the rewrites learned from events."""
    def build() -> Suggested:
        from prefixlake.registry.behaviour import NOW, alias_observations

        asked, _ = side_by_side(lambda: requests(spark, sf), lambda: catalog(spark, sf))
        memory, built = side_by_side(lambda: hold(upsert_aliases(empty_memory(spark), alias_observations(spark, sf))), lambda: model(spark, sf))
        return run(asked.drop("cust"), built, events=inp(spark, sf, "events"), now=F.lit(NOW).cast("timestamp"), memory=memory)

    return stage(spark, sf, "suggested", build)

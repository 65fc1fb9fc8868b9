"""All registered queries, by name."""

from __future__ import annotations

import importlib

MODULES = ["expressions", "sources", "understanding", "retrieval", "ranking", "vectors", "behaviour", "enrichment", "geography", "learning"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"prefixlake.registry.{name}")


def all_queries() -> dict:
    from prefixlake.registry.core import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from prefixlake.registry.core import ORACLES

    _load()
    return dict(ORACLES)

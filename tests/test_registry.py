"""Registered queries: names that resolve, and a renamed call."""

import ast
import importlib
from pathlib import Path

import duckdb

from prefixlake import registry
from prefixlake.registry.core import ORACLES
from prefixlake.sources.tables import STAR

SF = "/root/testdata/sf0.001"


def test_names_taken_from_modules_exist():
    for name in registry.MODULES:
        module = importlib.import_module(f"prefixlake.registry.{name}")
        for node in ast.walk(ast.parse(Path(module.__file__).read_text())):
            if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
                owner = getattr(module, node.value.id, None)
                if getattr(owner, "__name__", "").startswith("prefixlake."):
                    assert hasattr(owner, node.attr), f"{name}: {node.value.id}.{node.attr}"


def test_proposals_to_observations_equals_its_sql(spark):
    got = registry.all_queries()["l4_proposals_to_observations"](spark, SF).select("seq", "raw_query", "rewrite", "scope").collect()
    con = duckdb.connect()
    for t in STAR:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(f"select seq, raw_query, rewrite, scope from ({ORACLES['l4_proposals_to_observations']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_wide_radius_rows_match_the_check_sql(spark, tmp_path):
    """Customers beyond 50,000: a radius too wide, with and without a point."""
    spark.range(1, 400).selectExpr("id AS o_orderkey", "id * 307 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, registry.all_queries()["a15_validate_search_requests"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLES["a15_validate_search_requests"]).fetchall())

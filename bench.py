"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prefixlake.registry import all_queries  # noqa: E402
from prefixlake.session import build_session, tune  # noqa: E402

HEADLINE = [
    "b2_normalize_text", "b13_query_matches", "c1_expand_queries", "c2_build_lexicon", "d1_from_pairs", "d3_from_popular", "d8_from_templates",
    "e9_dedupe_text", "e10_top_k", "f2_sparse_index", "f3_sparse_knn", "f4_dense_knn", "g2_prefix_counts", "g3_transitions", "h3_behavior_boost",
    "i4_derive_attributes", "j1_nearby", "j3_geocode", "j13_route_legs", "j14_along_route", "k7_pairwise_deltas", "l1_upsert_aliases",
]
# the whole pipeline is timed on demand: BENCH_QUERIES=e12_suggest


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    registry = all_queries()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()

"""Run registered queries against their check SQL: ``python check.py [sf] [name-prefix ...]``."""

import sys
import time

import duckdb
import pandas as pd

from prefixlake.registry.core import ORACLES, QUERIES
from prefixlake.session import build_session
from prefixlake.sources.tables import STAR


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9)
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def main() -> None:
    sf, wanted = sys.argv[1], sys.argv[2:]
    import importlib

    from prefixlake.registry import MODULES

    for m in MODULES:
        try:
            importlib.import_module(f"prefixlake.registry.{m}")
        except ModuleNotFoundError as e:
            print("skip", m, e)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in STAR:
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    good = bad = rows_only = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            got = fn(spark, f"/root/testdata/{sf}").toPandas()
        except Exception as e:
            bad += 1
            print(f"ERROR {name} {time.time() - t:.1f}s {str(e)[:700]}", flush=True)
            continue
        spent = time.time() - t
        if name not in ORACLES:
            rows_only += 1
            print(f"rows  {name} {len(got)} rows {spent:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            want = con.execute(ORACLES[name]).df()
        except Exception as e:
            bad += 1
            print(f"SQLERR {name} {str(e)[:600]}", flush=True)
            continue
        sql_time = time.time() - t
        a, b = canon(got), canon(want)
        if list(a.columns) != list(b.columns):
            bad += 1
            print(f"COLS  {name} {list(a.columns)} vs {list(b.columns)}", flush=True)
        elif len(a) != len(b) or not a.equals(b):
            bad += 1
            print(f"DIFF  {name} {len(a)} vs {len(b)} rows", flush=True)
            cols = list(a.columns)
            m = a.merge(b, how="outer", on=cols, indicator=True)
            print(m[m["_merge"] != "both"].head(6).to_string(max_colwidth=60), flush=True)
        else:
            good += 1
            print(f"ok    {name} {len(a)} rows {spent:.1f}s sql {sql_time:.1f}s", flush=True)
    print(f"good {good} bad {bad} rows-only {rows_only}")


if __name__ == "__main__":
    main()

"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH / NO-ORACLE with row counts and time.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tessera.session import get_session  # noqa: E402

STRICT = os.environ.get("STRICT") == "1"      # compare doubles bit for bit

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v) else v)
        if str(df[c].dtype).startswith(("float", "Float")) and not STRICT:
            df[c] = df[c].astype("float64").round(9)
        if str(df[c].dtype) in ("boolean", "bool"):
            df[c] = df[c].astype(object)
    df = df.astype(object).where(pd.notna(df), None)
    rows = [tuple(r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            spd = sdf.toPandas()
        except Exception as e:                                    # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:28s} NO-ORACLE rows={len(spd)} cols={list(spd.columns)} {ts:.1f}s")
            continue
        try:
            dpd = con.execute(sql[name]).df()
        except Exception as e:                                    # noqa: BLE001
            print(f"{name:28s} SQL-ERROR {str(e)[:300]}")
            bad += 1
            continue
        if sorted(spd.columns) != sorted(dpd.columns):
            print(f"{name:28s} COLUMNS spark={sorted(spd.columns)} duck={sorted(dpd.columns)}")
            bad += 1
            continue
        a, b = norm(spd), norm(dpd)
        ok = a == b
        types = {c: (str(spd[c].dtype), str(dpd[c].dtype)) for c in spd.columns if str(spd[c].dtype) != str(dpd[c].dtype)}
        status = "OK" if ok else "MISMATCH"
        print(f"{name:28s} {status} rows={len(spd)}/{len(dpd)} {ts:.1f}s types={types}")
        if not ok:
            bad += 1
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print("   first diffs:", diff)
    print("BAD", bad)


if __name__ == "__main__":
    main()

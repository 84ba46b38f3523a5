"""Run every query in Spark and its oracle SQL in DuckDB; compare results.

Usage: python tools/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import collections
import importlib.util
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer():
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(df_pd):
    cols = sorted(df_pd.columns)
    out = collections.Counter()
    for rec in df_pd[cols].itertuples(index=False):
        out[tuple(str(norm(x)) for x in rec)] += 1
    return cols, out


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in args if not a.startswith("/")]
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    e = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(e)
    sys.path.insert(0, ROOT)
    from redline.session import local_session

    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sql = e.queries(), e.oracle_sql()
    ok = bad = 0
    for k in qs:
        if only and k not in only:
            continue
        if k not in sql:
            print(f"ROWS-ONLY {k}")
            continue
        t0 = time.time()
        try:
            sp = qs[k](spark, sf).toPandas()
            dk = con.execute(sql[k]).fetchdf()
        except Exception as ex:  # noqa: BLE001
            print(f"ERROR {k}: {type(ex).__name__}: {str(ex)[:400]}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dk)
        if c1 != c2 or r1 != r2:
            bad += 1
            print(f"MISMATCH {k}: spark rows={len(sp)} cols={c1} | duck rows={len(dk)} cols={c2}")
            if c1 == c2:
                only_s = list((r1 - r2).items())[:3]
                only_d = list((r2 - r1).items())[:3]
                print("   spark-only:", only_s)
                print("   duck-only :", only_d)
        else:
            ok += 1
            print(f"MATCH {k} rows={len(sp)} {round(time.time() - t0, 1)}s")
    print(f"matched={ok} failed={bad}")


if __name__ == "__main__":
    main()

"""Run queries() against oracle_sql() the way the driver does, and report.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names, and order-insensitive values (exact for
integers/strings; doubles compared exactly and, on mismatch, the max
absolute difference is printed to help diagnose).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from tessera.session import build_session  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(v + 0.0))
    if isinstance(v, (list, tuple)):
        return (3, repr([_norm(x) for x in v]))
    if hasattr(v, "tolist"):
        return (3, repr([_norm(x) for x in v.tolist()]))
    if isinstance(v, bool):
        return (4, str(v))
    if isinstance(v, int):
        return (2, repr(float(v))) if False else (5, str(v))
    return (6, str(v))


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def main():
    args = [a for a in sys.argv[1:] if a != "--plain"]
    sf = args[0] if args else "/root/testdata/sf0.01"
    only = set(args[1:])
    if "--plain" in sys.argv:  # a bare session, as an outside driver would create
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]")
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    ok_all = True
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {str(e)[:300]}")
            ok_all = False
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:28s} rows={len(srows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCKDB ERROR {str(e)[:300]}")
            ok_all = False
            continue
        same_cols = sorted(scols) == sorted(dcols)
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        same = same_cols and a == b
        ok_all &= same
        msg = "OK " if same else "MISMATCH"
        extra = ""
        if not same_cols:
            extra = f" cols spark-only={sorted(set(scols)-set(dcols))} duck-only={sorted(set(dcols)-set(scols))}"
        elif len(a) != len(b):
            extra = f" rows spark={len(a)} duck={len(b)}"
        elif not same:
            nd = sum(1 for x, y in zip(a, b) if x != y)
            first = next((x, y) for x, y in zip(a, b) if x != y)
            cs = sorted(scols)
            diffcols = [cs[i] for i in range(len(cs)) if first[0][i] != first[1][i]]
            extra = f" {nd} rows differ; cols {diffcols}; e.g. {[first[0][i] for i in range(len(cs)) if first[0][i]!=first[1][i]][:3]} vs {[first[1][i] for i in range(len(cs)) if first[0][i]!=first[1][i]][:3]}"
        print(f"{name:28s} {msg} rows={len(srows):7d} {ts:.1f}s{extra}")
    print("ALL OK" if ok_all else "SOME FAILED")


if __name__ == "__main__":
    main()

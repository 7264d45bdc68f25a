"""Run registered queries next to their SQL and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import tempfile
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a description; plus row count and seconds."""
    start = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return None, len(rows), seconds
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows), seconds
    order = sorted(names)
    got = sorted([tuple(cell(r[c]) for c in order) for r in rows])
    at = [names.index(c) for c in order]
    want = sorted([tuple(cell(r[i]) for i in at) for r in expected])
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}: {got[:2]} {want[:2]}", len(rows), seconds
    for g, w in zip(got, want):
        if g != w:
            return f"row {dict(zip(order, g))}\n   expected {dict(zip(order, w))}", len(rows), seconds
    return None, len(rows), seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from parityflow.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false pyspark-shell")
    spark = get_spark("check", "local[8]", 8, {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="harness-")})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sorted(set(oracles) - set(queries)):
        print("NO QUERY FOR", name)
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            problem, n, sec = compare(spark, con, fn, oracles.get(name), sf)
        except Exception as e:  # report and go on
            problem, n, sec = f"{type(e).__name__}: {str(e)[:1500]}", -1, 0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:34s} {n:8d} rows {sec:6.2f}s {problem or ''}", flush=True)
    print("failures:", bad)

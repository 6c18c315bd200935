"""Run registered queries next to their DuckDB statements and compare whole results.

    python tests/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DIGITS = int(os.environ.get("ORACLE_DIGITS", "9"))  # significant digits of floats that must agree
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.{DIGITS}g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(sf: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def compare(spark, con, sf, name, fn, sql):
    """(ok, message)."""
    t0 = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows {len(got)} (no SQL) {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    head = f"rows {len(a)} spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if a == b:
        return True, head
    missing = [r for r in b if r not in a][:3] if len(b) < 5000 else [y for x, y in zip(a, b) if x != y][:3]
    extra = [r for r in a if r not in b][:3] if len(a) < 5000 else [x for x, y in zip(a, b) if x != y][:3]
    return False, f"{head} want {len(b)}\n   columns {sorted(names)}\n   spark  {str(extra)[:600]}\n   duckdb {str(missing)[:600]}"


def main():
    from chatmill.session import local_session

    import __spark_entry__ as e

    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    a = p.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(a.sf), []
    queries, oracles = e.queries(), e.oracle_sql()
    for name, fn in queries.items():
        if a.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        try:
            ok, msg = compare(spark, con, a.sf, name, fn, oracles.get(name))
        except Exception as x:  # report and go on with the next query
            ok, msg = False, f"{type(x).__name__}: {str(x)[:700]}"
        print("ok  " if ok else "FAIL", name, msg, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(queries)} queries, {len(oracles)} with SQL, failed: {bad}")
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()

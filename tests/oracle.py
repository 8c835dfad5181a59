"""Run queries next to their check SQL and compare whole results.

python -m tests.oracle [--sf 0.01] [name prefixes...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
INTS = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(spark, con, sf_dir, fn, sql):
    """Empty string when equal, else what differs."""
    t = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    compare.seconds = time.time() - t
    if sql is None:
        return "" if got else "no rows", len(got)
    t = time.time()
    rel = con.execute(sql)
    desc = {c[0]: str(c[1]) for c in rel.description}
    rows = rel.fetchall()
    compare.sql_seconds = time.time() - t
    want_cols, want = normal(list(desc), rows)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    types = {c: (KIND.get(t, t), desc[c]) for c, t in df.dtypes}
    bad = {c: t for c, t in types.items() if t[0] != t[1]}
    if bad:
        return f"types {bad}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    if not got:
        return "no rows", 0
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(diff)} of {len(got)} rows differ, e.g. {diff[0]} {got_cols}" if diff else ""), len(got)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from contrapair.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        compare.seconds = compare.sql_seconds = 0.0
        try:
            msg, n = compare(spark, con, sf_dir, fn, checks.get(name))
        except Exception as e:  # report and go on to the next query
            msg, n = f"{type(e).__name__}: {str(e)[:700]}", 0
        failed += bool(msg)
        mark = "FAIL" if msg else ("ok" if name in checks else "rows")
        print(f"{mark:5s}{name:32s}{n:8d} rows {compare.seconds:7.2f}s  sql {compare.sql_seconds:6.2f}s  {msg}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())

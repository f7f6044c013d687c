"""Run registered queries against their SQL on the same files: ``python check.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from glob import glob
from os.path import basename

import duckdb

import catalog
from plumbline.session import local_session


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value) if not isinstance(value, int) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, q, sf_dir):
    """(ok, message, seconds)"""
    started = time.time()
    df = q.run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    if q.sql is None:
        return bool(got) , f"{len(got)} rows (no SQL)", seconds
    cur = con.execute(q.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", seconds
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}", seconds
    for a, b in zip(got, want):
        if a != b:
            return False, f"\n   spark {a}\n   sql   {b}", seconds
    return True, f"{len(got)} rows", seconds


def main(argv):
    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, q in catalog.load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, message, seconds = compare(spark, con, q, sf_dir)
        except Exception as e:  # report every query, then fail at the end
            ok, message, seconds = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {seconds:.2f}s {message}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

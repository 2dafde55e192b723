"""Runs queries() against oracle_sql() in DuckDB and compares the rows.

usage: python tests/check.py [--sf 0.01] [--only prefix,prefix]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def cell(v):
    if v is None:
        return ("null", "")
    if isinstance(v, bool):
        return ("bool", str(v))
    if isinstance(v, int):
        return ("int", str(v))
    if isinstance(v, float):
        return ("float", "nan" if math.isnan(v) else repr(v))
    if isinstance(v, Decimal):
        return ("decimal", format(v, "f"))
    if isinstance(v, (list, tuple)):
        return ("list", str([cell(x) for x in v]))
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, sql):
    """Returns (row count, problem or None)."""
    got_names = df.columns
    got = rows_of(got_names, [tuple(r) for r in df.collect()])
    names, raw = oracle_rows(con, sql)
    if sorted(names) != sorted(got_names):
        return len(got), f"columns {sorted(got_names)} vs {sorted(names)}"
    want = rows_of(names, raw)
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        g, w = bad[0]
        cells = [(a, b) for a, b in zip(g, w) if a != b]
        return len(got), f"{len(bad)} rows differ: spark {str(g)[:400]} duckdb {str(w)[:400]} cells {str(cells)[:400]}"
    return len(got), None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    args = ap.parse_args()
    import __spark_entry__ as entry

    from capturelake.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args.only and not any(name.startswith(p) for p in args.only.split(",")):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                n, problem = compare(df, con, oracle[name])
            else:
                n, problem = len(df.collect()), None
        except Exception as exc:  # report and go on
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
        took = time.time() - t0
        flag = "ok  " if problem is None else "FAIL"
        bad += problem is not None
        kind = "oracle" if name in oracle else "rows"
        print(f"{flag} {name:32s} {kind:6s} rows={n} {took:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)

"""Runs registered queries and their SQL twins side by side; also usable as a command.

python tests/oracle.py [--sf DIR] [name or name prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from workload.derived import TABLES  # noqa: E402


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(_value(x) for x in v)
    return v


def normal(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, name: str, query, sql: str | None, sf: str) -> str:
    start = time.time()
    df = query(spark, sf)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return f"rows {len(rows):>8}  {took:6.2f}s  {name}" if rows else f"EMPTY {name}"
    start = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    other = time.time() - start
    if sorted(cols) != sorted(want_cols):
        return f"COLUMNS {name}: {sorted(cols)} / {sorted(want_cols)}"
    got, exp = normal(cols, rows), normal(want_cols, want)
    if got != exp:
        gs, es = set(got), set(exp)
        extra = [r for r in got if r not in es][:3]
        missing = [r for r in exp if r not in gs][:3]
        return f"DIFF {name}: {len(got)} / {len(exp)} rows\n   spark only {extra}\n   sql only   {missing}"
    state = "ok  " if rows else "EMPTY"
    return f"{state} {len(rows):>8}  {took:6.2f}s / {other:5.2f}s  {name}"


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    import __spark_entry__ as entry
    from factloom.plans.session import local_session

    spark = local_session(8, "oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            print(compare(spark, con, name, query, sqls.get(name), args.sf), flush=True)
        except Exception as exc:  # report and go on
            print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)


if __name__ == "__main__":
    main()

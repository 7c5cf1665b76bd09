"""Run registered queries against their SQL: python tests/check_queries.py [sf_dir] [name part ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from quotemill.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name, exact values."""
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float):
            return repr(v)
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> tuple[str, int]:
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", len(got)
    a, b = canonical(got), canonical(want)
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"rows {len(a)} != {len(b)}; first difference {first}", len(got)
    return "", len(got)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if len(args) > 1 and not any(part in name for part in args[1:]):
            continue
        began = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, name, query, oracle[name])
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {n:8d} rows {time.time() - began:6.2f} s  {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())

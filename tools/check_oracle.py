"""Compare registered queries with their SQL twins in DuckDB.

    python tools/check_oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return "rows only", len(got)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    if off:
        return f"{len(off)} rows differ, first {str(off[0])[:400]}", len(got)
    odd = [
        f"{n}:{t}/{types[n]}" for n, t in df.dtypes if SAME_TYPE.get(t) != types[n]
    ]
    return ("ok" if not odd else f"ok, types {odd}"), len(got)


def main() -> int:
    from shelfmark.registry import ORACLES, QUERIES
    from shelfmark.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = get_session(cores="8"), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001 - a report of all queries is wanted
            verdict, n = f"ERROR {type(error).__name__}: {str(error)[:600]}", -1
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:26} {n:7d} rows {time.time() - start:6.1f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())

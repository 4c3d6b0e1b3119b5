"""Run registered queries beside their oracle SQL on a data directory and report mismatches.

python -m tests.compare [--sf DIR] [NAME...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{d}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x: object) -> object:
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        f = float(x)
        return None if math.isnan(f) else (f"{f:.6g}" if abs(f) > 1e-9 else "0")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows_of(cols: list[str], rows: list) -> list:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, d: str, query, sql: str | None) -> str:
    t = time.time()
    df = query(spark, d)
    got = df.collect()  # small inputs only
    t = time.time() - t
    if sql is None:
        return f"ok   {name}: {len(got)} rows, {t:.1f} s (no SQL)"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"FAIL {name}: columns {sorted(df.columns)} against {sorted(cols)}"
    have = rows_of(df.columns, got)
    if have == want:
        return f"ok   {name}: {len(have)} rows, {t:.1f} s"
    a, b = set(have) - set(want), set(want) - set(have)
    return f"FAIL {name}: {len(have)} against {len(want)} rows; only Spark {sorted(a, key=repr)[:3]}, only SQL {sorted(b, key=repr)[:3]}"


def main(args: list[str]) -> None:
    import __spark_entry__ as e
    from tickloom.session import build_session

    d = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        d, args = args[1], args[2:]
    spark = build_session("compare", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    q, s = e.queries(), e.oracle_sql()
    con = connect(d)
    for name in [n for n in q if not args or any(n == a or a.endswith("*") and n.startswith(a[:-1]) for a in args)]:
        try:
            print(compare(spark, con, name, d, q[name], s.get(name)), flush=True)
        except Exception as x:  # noqa: BLE001
            print(f"FAIL {name}: {type(x).__name__} {str(x)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])

"""Run registered queries next to their DuckDB twins and compare rows, names and values.

    python -m tests.oracle [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from gridstrata.sources import SCHEMAS


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return ("0",)
    if isinstance(value, float) and math.isnan(value):
        return ("0",)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and not isinstance(value, pd.Timestamp):
        items = value.tolist() if hasattr(value, "tolist") else list(value)
        return ("l", str([plain(v) for v in items])) if isinstance(items, list) else plain(items)
    if isinstance(value, dict):
        return ("d", str(sorted((k, plain(v)) for k, v in value.items())))
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float)):
        return ("n", repr(round(float(value), 6) + 0.0))
    if isinstance(value, pd.Timestamp) or hasattr(value, "isoformat"):
        return ("t", pd.Timestamp(value).isoformat())
    return ("s", str(value))


def kind(series: pd.Series) -> str:
    k = series.dtype.kind
    return {"i": "int", "u": "int", "f": "float", "M": "time", "b": "bool"}.get(k, "object")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c in got.columns:
        a, b = kind(got[c]), kind(want[c])
        if a != b and not got[c].isna().any():
            return f"type of {c}: {a} != {b}"
    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ in {sorted(got.columns)}:\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from gridstrata.session import build_session

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle", 8)
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            if name in oracles:
                sql_start = time.time()
                want = con.execute(oracles[name]).fetchdf()
                sql_took = time.time() - sql_start
                problem = compare(got, want)
            else:
                problem, sql_took = (None if len(got.columns) else "no columns"), 0.0
        except Exception as e:  # report and go on with the next query
            problem, took, sql_took, got = f"{type(e).__name__}: {str(e)[:1200]}", time.time() - start, 0.0, []
        status = "ok  " if problem is None else "FAIL"
        mark = "" if name in oracles else " (rows only)"
        print(f"{status} {name:34s} {took:6.2f}s duckdb {sql_took:5.2f}s rows {len(got)}{mark}", flush=True)
        if problem:
            failed.append(name)
            print("     " + problem, flush=True)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    spark.stop()


if __name__ == "__main__":
    main()

"""Run registered queries in Spark and their SQL in DuckDB, and compare the results.

As a script: ``python tests/compare.py [sf] [name prefix ...]``.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0
    return value


def order_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=order_key)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty where both sides agree on names, row count and every value."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    got_names = spark_df.columns
    result = con.execute(sql)
    want_names = [c[0] for c in result.description]
    want_rows = result.fetchall()
    found = []
    if sorted(got_names) != sorted(want_names):
        return [f"columns {sorted(got_names)} != {sorted(want_names)}"]
    if len(got_rows) != len(want_rows):
        found.append(f"rows {len(got_rows)} != {len(want_rows)}")
    got, want = rows_of(got_names, got_rows), rows_of(want_names, want_rows)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [
            (n, a, b) for n, a, b in zip(sorted(got_names), g, w) if a != b
        ]
        found.append(f"{len(bad)} rows differ, first: {cells[:4]} in {g[:6]}")
    kinds = dict(zip(want_names, [str(c[1]) for c in result.description]))
    for name, kind in spark_df.dtypes:
        want_kind = kinds[name]
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if kind in same and want_kind not in (same[kind], {"string": "STRING", "bigint": "NUMBER", "int": "NUMBER", "double": "NUMBER"}.get(kind)):
            found.append(f"type of {name}: {kind} != {want_kind}")
    return found


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from tabloom.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"{TESTDATA}/sf{scale}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = oracle_sql()
    failed = []
    for name, run in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                found = differences(df, con, sql[name])
                state = "same" if not found else "; ".join(found)
            else:
                state, found = f"rows {df.count()}", []
        except Exception as error:  # noqa: BLE001
            state = found = [f"{type(error).__name__}: {str(error)[:600]}"]
        if found:
            failed.append(name)
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

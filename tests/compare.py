"""Run queries on Spark and their SQL on DuckDB and compare rows whole.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v) if not isinstance(v, str) else v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) if r[i] is not None else "\0null" for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    ours = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        cells = [(n, x[:300], y[:300]) for n, x, y in zip(sorted(names), *bad[0]) if x != y]
        return f"{len(bad)} of {len(ours)} rows differ, first in {cells}"
    return None


def type_names(df, con, sql: str) -> list[str]:
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
             "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "DATE": "date"}
    theirs = {r[0]: kinds.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{n}: {t} / {theirs.get(n)}" for n, t in df.dtypes if theirs.get(n) != t]


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from anontext.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name, query in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            sql = oracle_sql().get(name)
            if sql is None:
                found = f"ROWS ONLY {df.count()}"
            else:
                found = difference(df, con, sql)
                failed += found is not None
                found = ("DIFF " + found) if found else "ok"
                kinds = type_names(df, con, sql)
                found += f"  types {kinds}" if kinds else ""
        except Exception as problem:  # noqa: BLE001 - report and go on
            failed, found = failed + 1, f"ERROR {type(problem).__name__} {str(problem)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {found}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())

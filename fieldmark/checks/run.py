"""Run registered queries against their SQL in DuckDB: ``python -m fieldmark.checks.run [sf_dir] [name part ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from fieldmark.checks import all_queries
from fieldmark.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    note = f"{len(got)} rows, {took:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {df.columns} vs {names}"
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"{note}; expected {len(want)} rows; first differences {odd}"
    return True, note


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    parts = args[1:]
    queries, oracles = all_queries()
    spark = build_session("checks", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            failed.append(name)
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())

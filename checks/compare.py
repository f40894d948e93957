"""Run named queries next to their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES
from forgeboard.session import local_session
from checks.mapping import TABLES


def _cell(value: object) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return repr(value)


def _sorted_rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[list[str]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([_cell(row[i]) for i in order] for row in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def difference(spark: SparkSession, db: duckdb.DuckDBPyConnection, name: str, folder: str) -> str:
    """Empty when both sides agree; else what differs first."""
    df = QUERIES[name](spark, folder)
    got_columns, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(ORACLE[name])
    want_columns, want = _sorted_rows([c[0] for c in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} instead of {want_columns}"
    if len(got) != len(want):
        missing = [w for w in want if w not in got][:2] if len(want) < 5000 else []
        return f"{len(got)} rows instead of {len(want)} {missing}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} instead of {b}"
    return "" if got else "both sides are empty"


def main(folder: str, *names: str) -> int:
    spark, db = local_session(8), connect(folder)
    bad = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            problem = difference(spark, db, name, folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok':5}{time.time() - started:6.2f}s {name} {problem}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)

"""The named queries next to their SQL in a second engine, over whole tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from forgeboard.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


def cell(value):
    return ("nan" if math.isnan(value) else f"{value:.6f}") if isinstance(value, float) else repr(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([cell(row[i]) for i in order] for row in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.execute(ORACLE[name])
    expected = rows([c[0] for c in want.description], want.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected
    assert expected[1]


def test_every_query_is_there():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, len(QUERIES) + 1))

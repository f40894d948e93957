"""Every named query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks import compare
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def db():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert compare.difference(spark, db, name, SMALL) == ""


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "login" and 0 < df.count() <= 100

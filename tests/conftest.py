from __future__ import annotations

from datetime import UTC, datetime

import pytest

from forgeboard.session import local_session
from forgeboard.sources.schema import REPO, USER

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    return Maker(spark)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


class Maker:
    """Small tables from keyword rows; columns left out are NULL or the stored default."""

    def __init__(self, spark):
        self.spark = spark

    def users(self, *rows: dict):
        blank = dict.fromkeys(USER.names) | {"hide": False, "is_admin": False, "company": ""}
        return self._frame(rows, blank, USER)

    def repos(self, *rows: dict):
        return self._frame(rows, dict.fromkeys(REPO.names), REPO)

    def frame(self, ddl: str, *rows: tuple):
        return self.spark.createDataFrame(list(rows), ddl)

    def _frame(self, rows, blank, schema):
        # Nullable here, so that broken rows can be made on purpose.
        loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema.fields])
        data = [tuple((blank | row)[n] for n in schema.names) for row in rows]
        return self.spark.createDataFrame(data, loose)


def repo(owner, name, stars=None, language="Go", **more):
    return {"owner": owner, "name": name, "stargazers_count": stars, "language": language, **more}


def column(df, name):
    return [row[name] for row in df.collect()]

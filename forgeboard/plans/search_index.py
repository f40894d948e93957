"""Searches that read only files which can hold the term, found by trigrams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeboard.functions.text import contains_pattern, literal_runs
from forgeboard.operators import search
from forgeboard.sources.snapshots import TABLES, SnapshotStore

#: Letters in a row that are looked up; terms without as many read whole tables.
GRAM = 3
#: Rows of a file that share a posting.
BLOCK_ROWS = 4096
#: Grams of a term that are looked up; more would narrow a search no further.
MOST_GRAMS = 64
#: Candidate files that are named one by one; with more, their parts are read whole.
MOST_FILES = 10_000

#: The texts that are searched, in the form they are compared in.
SEARCHED: dict[str, Callable[[], dict[str, Column]]] = {
    "users": lambda: {"login": F.col("login")},
    "repos": lambda: {"name": F.lower("name"), "description": F.lower("description")},
}
DONE = "table string, write string"
POSTINGS = "field string, gram string, file string, block long, part int, build string"


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, overlapping, in time linear in its length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def term_grams(pattern: str) -> list[str]:
    """Trigrams that any text matching a LIKE pattern must hold, evenly picked if they are many."""
    found = sorted({run[i : i + GRAM] for run in literal_runs(pattern) for i in range(len(run) - GRAM + 1)})
    step = -(-len(found) // MOST_GRAMS) or 1
    return found[::step]


class SearchIndex:
    """Posting lists of trigrams over the files of a snapshot store.

    What one write of the store holds never changes, so it is indexed once and
    serves all versions that share any part of it: a new version costs the
    parts it wrote. A posting says that some row among ``BLOCK_ROWS`` of a
    file holds a trigram in one field. A file is a candidate if one of its
    blocks holds all trigrams of the term in one field; LIKE then decides on
    its rows, so results are those of a search without the index.
    """

    def __init__(self, store: SnapshotStore, root: str):
        self.store = store
        self.spark = store.spark
        self.root = root.rstrip("/")

    def _done(self, table: str) -> dict[str, str]:
        """The build that holds each indexed write."""
        try:
            rows = self.spark.read.schema(f"{DONE}, build string").parquet(f"{self.root}/done")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        # Two builders may have indexed the same write; either will do.
        first = rows.filter(F.col("table") == table).groupBy("write").agg(F.min("build").alias("build"))
        return {r["write"]: r["build"] for r in first.collect()}

    def build(self, table: str, version: int) -> dict[str, str]:
        """Index the writes of a version that are not indexed yet; returns the build of each."""
        done = self._done(table)
        for write in sorted(set(self.store.where(table, version).values()) - set(done)):
            done[write] = self._index(table, write)
        return done

    def _index(self, table: str, write: str) -> str:
        build = uuid.uuid4().hex
        schema, _ = TABLES[table]
        texts = [F.struct(F.lit(name).alias("field"), text.alias("text")) for name, text in SEARCHED[table]().items()]
        rows = (
            self.spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())]))
            .parquet(f"{self.store.root}/{table}/write={write}")
            .select(
                F.inline(F.array(*texts)),
                "part",
                F.col("_metadata.file_name").alias("file"),
                F.floor(F.col("_metadata.row_index") / F.lit(BLOCK_ROWS)).cast("long").alias("block"),
            )
        )
        (
            rows.select("field", F.explode(grams(F.col("text"))).alias("gram"), "file", "block", "part")
            # A block lies in one or two tasks, which make its trigrams distinct before they move.
            .distinct()
            .hint("rebalance", "part")
            .sortWithinPartitions("part", "field", "gram")
            .write.partitionBy("part")
            .parquet(f"{self.root}/postings/{table}/build={build}")
        )
        # Written last: without it there is no build.
        self.spark.createDataFrame([(table, write)], DONE).coalesce(1).write.parquet(
            f"{self.root}/done/build={build}"
        )
        return build

    def candidates(self, table: str, version: int, pattern: str) -> list[tuple[int, str | None]] | None:
        """``(part, file)`` that may hold a match of a LIKE pattern; None if all may.

        A file of None stands for all files of its part.
        """
        wanted = term_grams(pattern)
        if not wanted:
            return None
        where = self.store.where(table, version)
        done = self.build(table, version)
        if not where:
            return []
        builds = sorted({done[w] for w in where.values()})
        base = f"{self.root}/postings/{table}"
        current = self.spark.createDataFrame([(p, done[w]) for p, w in where.items()], "part int, build string")
        files = (
            self.spark.read.schema(POSTINGS)
            .option("basePath", base)
            .parquet(*[f"{base}/build={b}" for b in builds])
            .filter(F.col("gram").isin(wanted))
            .join(current, ["part", "build"], "left_semi")
            .groupBy("part", "file", "field", "block")
            .agg(F.count("*").alias("held"))
            .filter(F.col("held") == len(wanted))
            .select("part", "file")
            .distinct()
        )
        found = files.limit(MOST_FILES + 1).collect()
        if len(found) > MOST_FILES:
            return [(r["part"], None) for r in files.select("part").distinct().collect()]
        return sorted((r["part"], r["file"]) for r in found)

    def _rows(self, table: str, version: int, found: list[tuple[int, str | None]]) -> DataFrame:
        schema, _ = TABLES[table]
        if not found:
            return self.spark.createDataFrame([], schema)
        base, where = f"{self.store.root}/{table}", self.store.where(table, version)
        paths = [f"{base}/write={where[p]}/part={p}" + (f"/{name}" if name else "") for p, name in found]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def search_repos(self, version: int, term: str, limit: int = 50) -> DataFrame:
        """``operators.search.search_repos`` over a version, from candidate files only."""
        # Lower case as the comparison has it, which is Spark's.
        folded = self.spark.range(1).select(F.lower(F.lit(contains_pattern(term)))).first()[0]
        found = self.candidates("repos", version, folded)
        rows = self.store.read(version).repos if found is None else self._rows("repos", version, found)
        return search.search_repos(rows, term, limit)

    def search_users(self, version: int, term: str, limit: int = 50) -> DataFrame:
        """``operators.search.search_users`` over a version, from candidate files and the totals of their parts."""
        found = self.candidates("users", version, contains_pattern(term))
        if found is None:
            now = self.store.read(version)
            return search.search_users(now.users, now.repos, term, limit, now.totals)
        users = self._rows("users", version, found)
        near = self.store.read(version, {part for part, _ in found})
        return search.search_users(users, near.repos, term, limit, near.totals)

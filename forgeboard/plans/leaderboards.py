"""Leaderboards of all languages, kept by part, with pages at any depth."""

from __future__ import annotations

import itertools
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeboard.functions.params import page_bounds
from forgeboard.operators.languages import (
    LanguagePage,
    by_owner,
    language_counts,
    leaders,
    most_popular,
)
from forgeboard.operators.paging import FEW, board_key, slice_of, total_step
from forgeboard.sources.schema import REPO, USER
from forgeboard.sources.snapshots import SnapshotStore, part_of


def _schema(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


INT, LONG, TEXT = T.IntegerType(), T.LongType(), T.StringType()
INDEX = _schema(part=INT, state=TEXT, holds=T.BooleanType(), build=TEXT)
PLACE = _schema(key=TEXT, step=INT, part=INT)
STEPS = _schema(part=INT, lang_key=TEXT, step=INT, owners=LONG, build=TEXT)
COUNTS = _schema(part=INT, language=TEXT, count=LONG, users=LONG, build=TEXT)


class Leaderboards:
    """Stored leaderboards of a snapshot store.

    An owner lies in one part of the store, so what a part adds to the
    leaderboards and to the counts of languages depends on that part alone.
    It is kept by part, for all languages at once, and serves every version
    in which the part is the same: a new version costs the parts it touched.
    Beside the rows lies a small histogram of them; summed over the parts it
    tells which rows a page has to read.
    """

    def __init__(self, store: SnapshotStore, root: str, few: int = FEW):
        self.store = store
        self.root = root.rstrip("/")
        self.few = few

    def _index(self) -> DataFrame:
        try:
            return self.store.spark.read.schema(INDEX).parquet(f"{self.root}/index")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.store.spark.createDataFrame([], INDEX)

    def _kept(self, states: dict[int, str]) -> dict[int, tuple[str, bool]]:
        """The build that holds each part as it is, and whether it holds any row."""
        spark = self.store.spark
        wanted = spark.createDataFrame(list(states.items()), "part int, state string")
        rows = self._index().join(wanted, ["part", "state"], "left_semi")
        # Two builders may have done the same part; either will do, and all take the same.
        first = rows.groupBy("part").agg(F.min_by(F.struct("build", "holds"), "build").alias("b"))
        return {r["part"]: (r["b"]["build"], r["b"]["holds"]) for r in first.collect()}

    def build(self, version: int) -> dict[int, tuple[str, bool]]:
        """Compute what is not kept yet of a version's parts; returns where each part lies."""
        parts, states = self.store.states(version)
        kept = self._kept(states)
        missing = sorted(set(states) - set(kept))
        if not missing:
            return kept
        build = uuid.uuid4().hex
        now = self.store.read(version, missing)
        order = ["part", "lang_key", "step", "key"]
        (
            by_owner(leaders(now.repos, now.users), "lang_key")
            .withColumn("key", board_key(F.col("count"), F.col("owner")))
            .withColumn("step", total_step(F.col("count")))
            .withColumn("part", part_of(F.col("owner"), parts))
            .hint("rebalance", "part")
            .sortWithinPartitions(*order)
            .write.partitionBy("part")
            .parquet(f"{self.root}/owners/build={build}")
        )
        rows = self._owners([f"{self.root}/owners/build={build}"])
        steps = rows.groupBy("part", "lang_key", "step").agg(F.count("*").alias("owners"))
        steps.write.parquet(f"{self.root}/steps/build={build}")
        (
            language_counts(now.repos.withColumn("part", part_of(F.col("owner"), parts)), "part")
            .write.parquet(f"{self.root}/languages/build={build}")
        )
        held = {r["part"] for r in rows.select("part").distinct().collect()}
        done = [(p, states[p], p in held, build) for p in missing]
        # Written last: without it there is no build.
        (
            self.store.spark.createDataFrame(done, INDEX)
            .drop("build")
            .coalesce(1)
            .write.parquet(f"{self.root}/index/build={build}")
        )
        return kept | {p: (build, holds) for p, _, holds, _ in done}

    def _owners(self, paths: list[str]) -> DataFrame:
        """Leaderboard rows of some folders."""
        spark = self.store.spark
        board = by_owner(leaders(*[spark.createDataFrame([], s) for s in (REPO, USER)]), "lang_key")
        schema = T.StructType([*board.schema.fields, *PLACE.fields])
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.root}/owners").parquet(*paths)

    def _partials(self, table: str, schema: T.StructType, kept: dict[int, tuple[str, bool]]) -> DataFrame:
        """The small rows kept beside the parts of a version."""
        spark = self.store.spark
        if not kept:
            return spark.createDataFrame([], schema)
        builds = sorted({build for build, _ in kept.values()})
        rows = spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        rows = rows.parquet(*[f"{self.root}/{table}/build={b}" for b in builds])
        wanted = spark.createDataFrame([(p, b) for p, (b, _) in kept.items()], "part int, build string")
        return rows.join(wanted, ["part", "build"], "left_semi")

    def popular_languages(self, version: int, limit: int = 50) -> DataFrame:
        """Languages by number of repositories, added up from the counts kept by part."""
        counts = self._partials("languages", COUNTS, self.build(version))
        totals = counts.groupBy("language").agg(
            F.sum("count").alias("count"), F.sum("users").alias("users")
        )
        return most_popular(totals, limit)

    def page(
        self, version: int, lang: str, limit: int | None = None, offset: int | None = None
    ) -> LanguagePage:
        """A page of the stored leaderboard; what is not kept yet is computed first.

        The histogram, at most 4,097 counts, tells the steps the page lies in;
        rows lie sorted by language and step, so no others are read.
        """
        limit, offset = page_bounds(limit, offset)
        kept = self.build(version)
        of_lang = F.col("lang_key") == F.lower(F.lit(lang))
        steps = self._partials("steps", STEPS, kept).filter(of_lang)
        counts = steps.groupBy("step").agg(F.sum("owners").alias("n")).orderBy("step").collect()
        ends = list(itertools.accumulate(row["n"] for row in counts))
        starts = [0, *ends[:-1]]
        within = [
            (row["step"], start)
            for row, start, end in zip(counts, starts, ends)
            if start < offset + limit and end > offset
        ]
        paths = [f"{self.root}/owners/build={b}/part={p}" for p, (b, holds) in sorted(kept.items()) if holds]
        rows = self._owners(paths if within else []).filter(of_lang)
        if within:
            first, start = within[0]
            rows = rows.filter(F.col("step").between(first, within[-1][0]))
            rows = slice_of(rows, "key", limit, offset - start, self.few)
        page = rows.select("owner", "repos", "count", "name", "type")
        total = steps.agg(F.coalesce(F.sum("owners"), F.lit(0)).alias("count"))
        return LanguagePage(page, total, lang)

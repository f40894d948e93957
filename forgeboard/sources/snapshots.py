"""Versioned Parquet snapshots of the users and repositories.

Rows are laid out in a fixed number of parts by a hash of the owner, case
folded. A login and all its repositories share a part, so a refresh rewrites
only the parts it touches and a lookup reads one. A version becomes visible
with one appended commit file that says, for every part, which write holds it;
readers of older versions are never disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeboard.functions.params import ParameterError
from forgeboard.operators.totals import owner_totals
from forgeboard.session import Stage, empty, stage_in, together
from forgeboard.sources.schema import REPO, RUN, USER, repo_violations, user_violations

TOTALS = T.StructType(
    [
        T.StructField("owner", T.StringType(), False),
        T.StructField("stars", T.LongType()),
        T.StructField("forks", T.LongType()),
    ]
)
TABLES = {"users": (USER, "login"), "repos": (REPO, "owner"), "totals": (TOTALS, "owner")}

COMMIT = T.StructType(
    [
        T.StructField("version", T.LongType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("parts", T.IntegerType(), False),
        T.StructField("table", T.StringType(), False),
        T.StructField("part", T.IntegerType()),
        T.StructField("write", T.StringType()),
    ]
)


REJECTS = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "owner", "name", "reason")])
FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("modified", T.TimestampType())])
VISITS = T.StructType(
    [
        T.StructField("login", T.StringType()),
        T.StructField("profile_at", T.TimestampType()),
        T.StructField("came", T.BooleanType()),
        T.StructField("started", T.TimestampType()),
    ]
)
#: Names, in a commit, the write that holds what a run kept beside the tables.
RUN_ROWS = "run"


class InvalidSnapshot(ValueError):
    """Rows that break a key or a required column were about to be published."""


@dataclass(frozen=True)
class Snapshot:
    """The tables as of one version. ``totals`` are the stored owner totals."""

    users: DataFrame
    repos: DataFrame
    totals: DataFrame | None = None


def part_of(owner: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lower(owner)), F.lit(parts)).cast("int")


class SnapshotStore:
    """Snapshots under one root folder. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark = spark
        self.root = root.rstrip("/")
        self._new_parts = parts

    # -- commits ---------------------------------------------------------

    def _commits(self) -> DataFrame:
        try:
            commits = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true")
            return commits.parquet(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty(self.spark, COMMIT)

    def latest(self) -> int | None:
        return self._commits().agg(F.max("version")).first()[0]

    def has_batch(self, source: str, batch: int) -> bool:
        """Whether a stream's batch is already part of a version."""
        return not self._commits().filter(
            (F.col("source") == source) & (F.col("batch") == batch)
        ).isEmpty()

    def _layout(self, version: int | None) -> tuple[int, dict[str, dict[int, str]]]:
        """Parts in all, and per table the write that holds each part (at most parts rows)."""
        layout: dict[str, dict[int, str]] = {name: {} for name in TABLES}
        parts = self._new_parts
        if version is not None:
            for row in self._commits().filter(F.col("version") == version).collect():
                parts = row["parts"]
                if row["part"] is not None:
                    layout[row["table"]][row["part"]] = row["write"]
        return parts, layout

    def states(self, version: int) -> tuple[int, dict[int, str]]:
        """Parts in all, and what each part with repositories is made of.

        A part whose state is the same in two versions holds the same rows in both.
        """
        parts, layout = self._layout(version)
        return parts, {p: f"{layout['users'].get(p)} {w}" for p, w in layout["repos"].items()}

    def where(self, table: str, version: int) -> dict[int, str]:
        """The write that holds each part of a table; what one write holds never changes."""
        return self._layout(version)[1][table]

    # -- reading ---------------------------------------------------------

    def _load(self, table: str, where: dict[int, str]) -> DataFrame:
        schema, _ = TABLES[table]
        if not where:
            return empty(self.spark, schema)
        base = f"{self.root}/{table}"
        return (
            self.spark.read.schema(schema)
            .option("basePath", base)
            .parquet(*[f"{base}/write={w}/part={p}" for p, w in sorted(where.items())])
            .select(*schema.names)
        )

    def read(
        self,
        version: int | None = None,
        parts: Iterable[int] | None = None,
        owner: str | None = None,
    ) -> Snapshot:
        """A version (the latest if not said), whole or only some parts.

        ``owner`` narrows it to the one part where that owner, in any case,
        must lie.
        """
        version = self.latest() if version is None else version
        total, layout = self._layout(version)
        if owner is not None:
            parts = [self.spark.range(1).select(part_of(F.lit(owner), total)).first()[0]]
        wanted = None if parts is None else set(parts)

        def table(name: str) -> DataFrame:
            where = layout[name]
            return self._load(
                name, where if wanted is None else {p: w for p, w in where.items() if p in wanted}
            )

        return Snapshot(table("users"), table("repos"), table("totals"))

    def touched_parts(self, owners: DataFrame) -> list[int]:
        """The parts that hold the given ``owner`` values; never more than there are parts."""
        total, _ = self._layout(self.latest())
        rows = owners.select(part_of(F.col("owner"), total).alias("part")).distinct().collect()
        return sorted(r["part"] for r in rows)

    # -- the run log -----------------------------------------------------

    def runs(self) -> DataFrame:
        try:
            return self.spark.read.schema(RUN).parquet(f"{self.root}/runs")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty(self.spark, RUN)

    def log_run(self, started_at: datetime) -> None:
        """Logged before any work, so a run that fails still counts."""
        self.spark.createDataFrame([(started_at,)], RUN).coalesce(1).write.mode("append").parquet(
            f"{self.root}/runs"
        )

    def staged(self, started_at: datetime) -> Stage:
        """Where a run keeps its parsed payloads."""
        return stage_in(f"{self.root}/staging/{started_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}")

    def new_write(self) -> str:
        """A name for what is about to be written; it counts once a version names it."""
        return f"{(self.latest() or 0) + 1:010d}-{uuid.uuid4().hex[:8]}"

    def keep(self, write: str, table: str, rows: DataFrame) -> None:
        """Rows that go with a version: ``rejects``, ``files``, ``visits`` or ``pending``."""
        rows.write.parquet(f"{self.root}/{table}/write={write}")

    def _of_versions(self, table: str, schema: T.StructType, newest: bool = False) -> DataFrame:
        """Rows written along with versions, or with the newest, without those of writes that came to nothing."""
        with_write = T.StructType([*schema.fields, T.StructField("write", T.StringType())])
        try:
            rows = self.spark.read.schema(with_write).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty(self.spark, schema)
        named = self._commits().filter(F.col("table") == RUN_ROWS)
        named = named.agg(F.max_by("write", "version").alias("write")) if newest else named.select("write")
        return rows.join(named, "write", "left_semi").select(*schema.names)

    def rejects(self) -> DataFrame:
        """Payload rows and accounts that no version could take, with the reason."""
        return self._of_versions("rejects", REJECTS)

    def files(self) -> DataFrame:
        """The landed files that versions took in."""
        return self._of_versions("files", FILES)

    def visits(self) -> DataFrame:
        """Accounts visited: when the profile came, whether it was good, when the listing began."""
        return self._of_versions("visits", VISITS)

    def pending(self, schema: T.StructType) -> DataFrame:
        """Lines that wait for the profile of their account."""
        return self._of_versions("pending", schema, newest=True)

    # -- publishing ------------------------------------------------------

    def _write(self, table: str, df: DataFrame, parts: int, write: str) -> set[int]:
        """Write one table by part and return the parts that hold any row.

        The rebalance hint gathers each part for few files and splits a part
        that outgrows the advisory size, such as that of a hot owner. Files
        are sorted by owner, so a lookup skips row groups by their bounds.
        """
        schema, owner = TABLES[table]
        path = f"{self.root}/{table}/write={write}"
        (
            df.select(*schema.names)
            .withColumn("part", part_of(F.col(owner), parts))
            .hint("rebalance", "part")
            .sortWithinPartitions("part", owner)
            .write.partitionBy("part")
            .parquet(path)
        )
        return {
            r["part"] for r in self._written(table, write).select("part").distinct().collect()
        }

    def _written(self, table: str, write: str) -> DataFrame:
        schema, _ = TABLES[table]
        with_part = T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])
        return self.spark.read.schema(with_part).parquet(f"{self.root}/{table}/write={write}")

    def publish(
        self,
        snapshot: Snapshot,
        touched: Iterable[int] | None = None,
        source: str | None = None,
        batch: int | None = None,
        check: bool = True,
        write: str | None = None,
    ) -> int:
        """Write the next version and make it visible; returns its number.

        ``touched`` says which parts the snapshot holds; the others carry over
        from the version before without being read. Keys are checked on the
        written rows of the touched parts, which settles uniqueness for the
        whole table because equal keys share a part. ``check`` may be left out
        for rows whose keys are right by the way they were made.
        """
        before = self.latest()
        parts, layout = self._layout(before)
        if touched is not None and before is None:
            touched = None
        replaced = set(range(parts)) if touched is None else set(touched)
        version = 1 if before is None else before + 1
        named = write is not None
        write = write or self.new_write()
        next_layout = {
            name: {p: w for p, w in layout[name].items() if p not in replaced} for name in TABLES
        }

        def put(name: str, df: DataFrame) -> None:
            held = self._write(name, df, parts, write)
            stray = held - replaced
            if stray:
                raise ParameterError(f"{name} holds rows of parts not declared touched: {sorted(stray)}")
            next_layout[name].update({p: write for p in held})

        together(lambda: put("users", snapshot.users), lambda: put("repos", snapshot.repos))
        checks = [
            lambda: self._check("users", user_violations(self._written("users", write))),
            lambda: self._check("repos", repo_violations(self._written("repos", write))),
        ]
        together(
            *(checks if check else []), lambda: put("totals", owner_totals(self._written("repos", write)))
        )

        rows = [
            (version, source, batch, parts, name, p, w)
            for name, where in next_layout.items()
            for p, w in (sorted(where.items()) or [(None, None)])
        ]
        if named:
            rows.append((version, source, batch, parts, RUN_ROWS, None, write))
        # One file under the version's own name: one step from the old version
        # to the new, and a second writer of the same version fails.
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("error").parquet(
            f"{self.root}/commits/{version:010d}"
        )
        return version

    @staticmethod
    def _check(table: str, violations: DataFrame) -> None:
        sample = violations.take(5)
        if sample:
            raise InvalidSnapshot(f"{table}: " + "; ".join(str(r.asDict()) for r in sample))

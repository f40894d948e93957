"""The log of collection runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeboard.sources.schema import RUN


def last_run(runs: DataFrame) -> DataFrame:
    """One row; NULL when nothing ran yet."""
    return runs.agg(F.max("created_at").alias("created_at"))


def append_run(runs: DataFrame, started_at: datetime) -> DataFrame:
    """The log with one more start time."""
    return runs.unionByName(runs.sparkSession.createDataFrame([(started_at,)], RUN))

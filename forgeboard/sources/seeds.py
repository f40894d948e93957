"""Seed logins from a text file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """One login per line; the empty line a closing newline leaves is dropped."""
    return spark.read.text(path).select(F.col("value").alias("login")).filter("login <> ''")

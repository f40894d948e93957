"""What the operators share on the Spark side."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names.

    Other columns may have any name, also one that differs only in case or
    that occurs twice; of two columns of the same name the first counts.
    """
    columns = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{columns.index(name)}").alias(name) for name in names])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, and bound the Arrow batches sent to them.

    The path is that of this checkout; on a cluster without it, ship the
    package with ``--py-files``.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def partitions_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))

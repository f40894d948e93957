"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Stage = Callable[..., DataFrame]

# Settings the plans rely on. Joins on an owner can meet a hot owner, which
# adaptive execution splits; the forced form splits it even when the join
# output has to be shuffled again.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Let a sort-merge join become a hash join where every partition of the
    # smaller side is seen at run time to stay under this size.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Staged payloads are text, and every step of a refresh writes some.
    "spark.sql.parquet.compression.codec": "zstd",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session that already runs."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("forgeboard")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="forgeboard-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. A local
    folder is made only in local mode, where driver and executors are one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form that lets the optimizer drop the joins and unions it is part of."""
    return spark.createDataFrame([], schema).filter("false")


def together(*steps: Callable[[], Any]) -> list[Any]:
    """Run steps that do not need each other at once, so that the tail of one's tasks leaves no core idle.

    All are waited for; then the first that failed raises.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(step)) for step in steps]
    return [step.result() for step in running]


def stage_in(folder: str) -> Stage:
    """Write tables below ``folder``, parted by the columns named, and hand back what can be read there.

    What was written survives the loss of any executor, is computed once, and
    has a size the optimizer knows.
    """

    def stage(name: str, df: DataFrame, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return stage

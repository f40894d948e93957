"""Payload files as a stream: each micro-batch is one refresh."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forgeboard.plans.refresh import kind_of, run
from forgeboard.session import shared_dir, stage_in
from forgeboard.sources.payload import ENVELOPE, arrival_order, file_position
from forgeboard.sources.snapshots import SnapshotStore


def stream_refresh(
    store: SnapshotStore,
    landing: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Refresh ``store`` from files of envelope lines as they land.

    An account's lines may lie in several files. Those that come before its
    profile wait in the store, whatever the number of micro-batches, and count
    once the profile is there; those that come after it follow what became of
    it. A late line that cannot be read no longer keeps its listing, once
    applied, from pruning. Files are known by path and modification time: those
    that a version has taken in are passed over, whether the checkpoint replays
    a batch or a new one starts from the first file.
    """
    spark = store.spark
    reader = spark.readStream.schema(ENVELOPE)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    landed_file = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ]
    lines = reader.json(landing).select(*ENVELOPE.names, file_position().alias("stretch"), *landed_file)

    def apply(items: DataFrame, batch: int) -> None:
        # Lines are numbered here, where a batch is an ordinary scan of its files.
        stage = stage_in(shared_dir(spark, "landed"))
        columns = [*ENVELOPE.names, arrival_order(F.col("stretch")), kind_of(), "file", "modified"]
        numbered = stage("lines", items.select(*columns), "of")
        files = numbered.select("file", "modified").distinct()
        fresh = stage("files", files.join(store.files(), ["file", "modified"], "left_anti"))
        if fresh.isEmpty():
            return
        kept = numbered.join(fresh, ["file", "modified"], "left_semi").drop("file", "modified")
        run(store, kept, datetime.now(UTC), files=fresh, hold=True)

    writer = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

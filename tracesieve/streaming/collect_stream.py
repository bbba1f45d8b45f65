"""Collect as files arrive: the batch plan, run on the names of each micro-batch.

The stream itself reads names only, so a file of any size is collected, or fails, as in a batch run.
Its checkpoint remembers names; files that change under their name are the work of
:func:`~tracesieve.plans.collect_files.collect_changed`, which writes to the same target.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracesieve.plans.collect_files import FILES_PER_BATCH, collect_files, collected_manifest, collected_rows
from tracesieve.sources.sessions import LONG_BYTES, SESSION_FILES

BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_collect(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    secrets: DataFrame | None = None,
    deny: Iterable[str] = (),
    reject: DataFrame | None = None,
    strip_images: bool = False,
    files_per_batch: int = FILES_PER_BATCH,
    long_bytes: int = LONG_BYTES,
    extra_rules: Iterable[str] = (),
) -> StreamingQuery:
    """Collect all files not seen before and stop.

    Every batch overwrites its own folder under ``target``, so a batch that is run again
    after a failure replaces what it left.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("pathGlobFilter", SESSION_FILES)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
    )
    deny, extra = list(deny), list(extra_rules)

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # ``files_per_batch`` at most
        if paths:
            collect_files(
                spark, paths, target, secrets, deny, reject,
                strip_images=strip_images, long_bytes=long_bytes, batch=batch_id, extra_rules=extra,
            )

    return (
        files.select("path")
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def streamed_sessions(spark: SparkSession, target: str) -> DataFrame:
    """Collected rows of all batches, whatever their outcome."""
    return collected_rows(spark, target)


def streamed_manifest(spark: SparkSession, target: str) -> DataFrame:
    """The manifest over all batches: the newest row of each session."""
    return collected_manifest(spark, target)

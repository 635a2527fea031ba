"""Running a stream to the end of its input, or leaving it running."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specflow.session import work_path

#: batches whose progress a run keeps, for the count of dropped rows
PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
KEPT = 100_000


class LateRowsDropped(RuntimeError):
    """A run that should be whole dropped rows behind its watermark."""


def start_each(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True,
               pause: str = "60 seconds", mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=pause)
    return writer.start()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped behind the watermark, over the batches whose progress is kept."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def run_each(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Runs over everything available; returns how many rows were dropped as late."""
    conf = stream.sparkSession.conf
    before = conf.get(PROGRESS)
    try:
        conf.set(PROGRESS, str(KEPT))
        query = start_each(stream, each, checkpoint, mode=mode)
    finally:
        conf.set(PROGRESS, before)
    query.awaitTermination()
    return dropped_rows(query)


def newest_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the newest ``batch_no`` folder, whichever process wrote it."""
    every = spark.read.option("basePath", folder).parquet(f"{folder}/batch_no=*")
    newest = every.agg(F.max("batch_no").alias("n")).first()["n"]
    return every.filter(F.col("batch_no") == F.lit(newest))


def run_to_folder(stream: DataFrame, label: str, mode: str = "append", whole: bool = False, out: str | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """Runs over everything available; each batch overwrites its own folder, so a retried
    batch cannot count twice. In complete mode the newest batch holds all rows and is read alone.

    A run that is to be ``whole`` fails when rows came later than the watermark allows. ``out`` and
    ``checkpoint`` name folders that an earlier run left, to go on from there.
    """
    spark: SparkSession = stream.sparkSession
    out, checkpoint = out or work_path(spark, label), checkpoint or work_path(spark, f"{label}-checkpoint")
    schema = stream.schema

    def store(batch: DataFrame, number: int) -> None:
        # a batch without rows leaves its columns as well, so that it can be the newest one
        batch.write.mode("overwrite").parquet(f"{out}/batch_no={number}")

    lost = run_each(stream, store, checkpoint, mode)
    if whole and lost:
        raise LateRowsDropped(f"{label}: {lost} rows came behind the watermark and were dropped")
    if mode == "complete":
        return newest_batch(spark, out).select(*schema.names)
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch_no=*")

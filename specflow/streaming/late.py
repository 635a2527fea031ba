"""Late events on a stream: judged against a persisted mark of event time, rejected ones kept aside.

Spark's own watermark drops rows silently, and only inside a stateful operator. Here every batch is
judged as a whole against the latest event time of the batches before it. That mark is written
with the batch, in a folder of its own; a batch that runs again finds the mark of the batch before
it, gives every event the same verdict and overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.operators.windows import WINDOW_CLOSED, arrival_verdict
from specflow.session import stored


def mark_before(batch: DataFrame, folder: str, number: int):
    """Latest event time of all batches before this one; None before the first."""
    if number == 0:
        return None
    return batch.sparkSession.read.schema("mark timestamp").parquet(f"{folder}/marks/batch_no={number - 1}").first()["mark"]


def late_writer(ts: str, close: Column, folder: str, allow_late: bool, tolerance_ms: int) -> Callable[[DataFrame, int], None]:
    """Per batch: ``accepted`` events with their verdict (ON_TIME or LATE), ``rejected`` ones with the
    reason, and the mark after it.

    ``close`` is the closing time of an event's window, as an expression over the event. The stream
    has reached the mark when the batch arrives, so that is each event's arrival time.
    """

    def each(batch: DataFrame, number: int) -> None:
        mark = mark_before(batch, folder, number)
        events = batch.withColumn(ts, F.col(ts).cast("timestamp"))
        reached = F.lit(mark).cast("timestamp")
        verdict = F.when(reached.isNull(), "ON_TIME").otherwise(arrival_verdict(reached, close, allow_late, tolerance_ms))
        judged = stored(events.withColumn("verdict", verdict), "judged")
        closed = F.col("verdict") == WINDOW_CLOSED
        judged.filter(~closed).write.mode("overwrite").parquet(f"{folder}/accepted/batch_no={number}")
        rejected = judged.filter(closed).withColumnRenamed("verdict", "reason")
        rejected.write.mode("overwrite").parquet(f"{folder}/rejected/batch_no={number}")
        # null when neither this batch nor an earlier one has an event
        after = judged.agg(F.greatest(F.max(ts), reached).alias("mark")).coalesce(1)
        after.write.mode("overwrite").parquet(f"{folder}/marks/batch_no={number}")

    return each


def side(batch_folder: str, stream: DataFrame, kind: str) -> DataFrame:
    """All ``accepted`` or all ``rejected`` events of the batches so far, with ``batch_no``."""
    return stream.sparkSession.read.option("basePath", f"{batch_folder}/{kind}").parquet(f"{batch_folder}/{kind}/batch_no=*")

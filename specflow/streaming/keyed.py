"""Count and marker windows on streams, with the per-key state in a table.

A stateful operator would send all events of a key in a batch through one task. Here a
batch is numbered by the same split-safe running sums as in batch mode and offset by the
key's count so far. Each batch appends the counts of the keys it touched and overwrites
only its own folder; every few batches a snapshot bounds how much log is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.operators.ordered import running_sum
from specflow.session import checkpointed

SNAPSHOT_EVERY = 20


class KeyedCounts:
    """The running count per key as of the batch before."""

    def __init__(self, folder: str, keys: tuple[str, ...]):
        self.folder, self.keys = folder, keys

    def before(self, batch: DataFrame, number: int) -> DataFrame | None:
        if number == 0:
            return None
        spark = batch.sparkSession
        start = (number - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
        paths = [f"{self.folder}/log/{n}" for n in range(start, number)]
        if start:
            paths.append(f"{self.folder}/snapshot/{start}")
        log = spark.read.parquet(*paths)
        return log.groupBy(*self.keys).agg(F.max_by("total", "batch_no").alias("total"))

    def after(self, touched: DataFrame, known: DataFrame | None, number: int) -> None:
        """``touched`` has the keys and ``added``. The next snapshot holds all keys seen before it."""
        added = touched if known is None else touched.join(known, list(self.keys), "left")
        base = F.lit(0).cast("bigint") if known is None else F.coalesce("total", F.lit(0).cast("bigint"))
        rows = added.select(*self.keys, (base + F.col("added")).alias("total"), F.lit(number).alias("batch_no"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/log/{number}")
        if (number + 1) % SNAPSHOT_EVERY == 0:
            whole = self.before(touched, number + 1)
            marked = whole.select(*self.keys, "total", F.lit(number).alias("batch_no"))
            marked.write.mode("overwrite").parquet(f"{self.folder}/snapshot/{number + 1}")


def _numbered(keys: tuple[str, ...], order: tuple[str, ...], step: Column, state: str, out: str,
              place: Callable[[Column, Column], Column]) -> Callable[[DataFrame, int], None]:
    counts = KeyedCounts(state, keys)

    def each(batch: DataFrame, number: int) -> None:
        held = checkpointed(batch.withColumn("_step", step))
        known = counts.before(held, number)
        run = running_sum(held, keys, order, F.col("_step"), "_upto")
        if known is not None:
            run = run.join(known, list(keys), "left")
            run = run.withColumn("_upto", F.col("_upto") + F.coalesce("total", F.lit(0).cast("bigint"))).drop("total")
        placed = run.withColumn("window_no", place(F.col("_upto"), F.col("_step"))).drop("_upto", "_step")
        placed.write.mode("overwrite").parquet(f"{out}/batch_no={number}")
        counts.after(held.groupBy(*keys).agg(F.sum("_step").alias("added")), known, number)

    return each


def count_windows(keys: tuple[str, ...], order: tuple[str, ...], size: int, state: str, out: str):
    """Every ``size`` arrivals of a key form a window."""
    return _numbered(keys, order, F.lit(1).cast("bigint"), state, out,
                     lambda upto, step: F.floor((upto - 1) / size).cast("bigint"))


def marker_windows(keys: tuple[str, ...], order: tuple[str, ...], marker: Column, state: str, out: str):
    """A marker event closes the key's window."""
    return _numbered(keys, order, F.coalesce(marker, F.lit(False)).cast("bigint"), state, out,
                     lambda upto, step: upto - step)

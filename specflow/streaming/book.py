"""The ledger of files as a compacted log that several streams write at once.

A commit adds the rows of one batch of one stream. Rows lie in folders by a hash of the file name, so
a batch reads only the folders that its own files fall into, and every ``SNAPSHOT_EVERY`` commits all
rows so far are written together, so it reads one snapshot and a bounded number of commits
after it. Two streams that find the same file new meet at the commit: the second sees that the
number is taken, looks at what was added meanwhile and leaves out what it no longer needs to add.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.commits import CommitLog
from specflow.operators import ledger
from specflow.session import stored

SNAPSHOT_EVERY = 20
BUCKETS = 64
TRIES = 100
ROWS = "integration_id bigint, remote_file_name string, n_lines bigint, processing_status string, stream string, batch_no int"


class Book:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder, CommitLog(spark, folder)

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], f"{ROWS}, bucket int")
        # every folder is read by itself: a base path would make its name a column
        return self.spark.read.schema(f"{ROWS}, bucket int").option("basePath", f"{self.folder}/rows").parquet(
            *[f"{self.folder}/rows/commit={n}" for n in names]).drop("commit")

    def names(self, upto: int) -> list[str]:
        """Folders that together hold all rows as of a commit: a snapshot and the commits after it."""
        return list(self.log.entry(upto)["folders"]) if upto >= 0 else []

    def read(self) -> DataFrame:
        """All rows of the ledger, whichever streams wrote them."""
        return self._rows(self.names(self.log.newest())).drop("bucket")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.partitionBy("bucket").parquet(f"{self.folder}/rows/commit={name}")
        return name

    def add(self, listing: DataFrame, stream: str, number: int) -> int:
        """Adds the files of a batch that no batch has added; returns how many folders were read.

        A batch that runs again after its commit adds nothing.
        """
        bucket = F.pmod(F.hash("remote_file_name"), F.lit(BUCKETS)).alias("bucket")
        own = stored(listing.select("*", F.lit(stream).alias("stream"), F.lit(number).alias("batch_no"), bucket), "listing")
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]
        fresh, known, read = own, [], 0
        for _ in range(TRIES):
            newest = self.log.newest()
            entry = self.log.entry(newest) if newest >= 0 else {"folders": [], "done": {}}
            if entry["done"].get(stream, -1) >= number:
                return read
            # only what was added since the last look
            unread = [n for n in entry["folders"] if n not in known]
            before = self._rows(unread).filter(F.col("bucket").isin(touched) if touched else F.lit(False))
            fresh = stored(ledger.unseen(fresh, before), "fresh")
            known, read = entry["folders"], read + len(unread)
            folders = entry["folders"] if fresh.isEmpty() else [*entry["folders"], self._write(fresh)]
            if len(folders) > SNAPSHOT_EVERY:
                folders = [self._write(self._rows(folders))]
            done = {**entry["done"], stream: number}
            if self.log.commit(newest + 1, {"folders": folders, "done": done}):
                return read
        raise RuntimeError(f"{TRIES} other writers came first")


def ledger_writer(folder: str, integration: int, stream: str) -> Callable[[DataFrame, int], None]:
    """Per batch: a ledger row for each file that no other batch of any stream has in the ledger.

    ``stream`` names a stream with a checkpoint of its own; streams may run at the same time.
    """

    def each(batch: DataFrame, number: int) -> None:
        listing = batch.groupBy(F.col("_file").alias("remote_file_name")).agg(F.count(F.lit(1)).alias("n_lines"))
        rows = listing.select(F.lit(integration).cast("bigint").alias("integration_id"), "remote_file_name", "n_lines",
                              F.lit("PENDING").alias("processing_status"))
        Book(batch.sparkSession, folder).add(rows, stream, number)

    return each


def read_book(spark: SparkSession, folder: str) -> DataFrame:
    return Book(spark, folder).read()

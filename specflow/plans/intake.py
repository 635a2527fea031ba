"""Directory to ledger to pending queue to processed records.

``poll`` takes in a folder file by file without letting one bad file stop the others. Files that
cannot be read are found by halving: a job reads all files of the poll, and only when it
fails its halves are tried by themselves. Such a file is tried again by later polls; after the
last try it is set aside with status FAILED. Every poll is one commit of the intake's log, so a poll
that breaks off half way leaves no trace in the ledger and the next one does its work again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.commits import CommitLog, Files
from specflow.operators import ledger, route
from specflow.plans.inbound import processed
from specflow.session import checkpointed, stored
from specflow.sinks.envelope import envelopes
from specflow.sources import read_records
from specflow.sources.lines import loadable
from specflow.sources.listing import file_facts
from specflow.spec import FileSpec
from specflow.streaming.sources import poll_size


def take_in(listing: DataFrame, book: DataFrame, order: list[str]) -> DataFrame:
    """Ledger after the listing: new files appear once, as PENDING."""
    return ledger.append(listing, book, order)


def file_outcomes(parsed: DataFrame, spec: FileSpec, pending: DataFrame, file_column: str = "remote_file_path",
                  skip_invalid: bool = False) -> DataFrame:
    """Run summary and ledger status per pending file; a run without any good record FAILED.

    A file without records was processed as well: its counters are 0.
    """
    wanted = pending.select(F.col(file_column).alias("_file"))
    done = processed(parsed.join(wanted, "_file", "left_semi"), spec, skip_invalid)
    counted = route.summarise(done, ("_file",))
    summary = route.with_status(wanted.join(counted, "_file", "left").fillna(0, [c for c in counted.columns if c != "_file"]))
    state = F.when(F.col("status") == "FAILED", "FAILED").otherwise("PROCESSED")
    return summary.withColumn("processing_status", state)


# How often a file is tried, files per poll, and what becomes of files that were taken in.
TRIES = 3
PER_POLL = 20
AFTER = ("LEAVE", "ARCHIVE", "MOVE", "DELETE")


def unreadable(files: list[str], read: Callable[[list[str]], None]) -> dict[str, str]:
    """The files that ``read`` fails on, with the reason. One call when all are good; else halves are tried."""
    if not files:
        return {}
    try:
        read(files)
        return {}
    except (PySparkException, Py4JJavaError) as problem:
        if len(files) == 1:
            said = str(problem)
            causes = re.findall(r"(?m)^\s*Caused by: (.*)$", said)
            return {files[0]: (causes[-1] if causes else said.splitlines()[0])[:500]}
    half = len(files) // 2
    return unreadable(files[:half], read) | unreadable(files[half:], read)


@dataclass
class FolderIntake:
    """A folder taken in by polls. ``home`` holds the log, the ledger rows and the outputs of each poll.

    Files set aside go to ``aside``; those taken in are left, deleted, or moved below ``archive``.
    A poll takes ``per_poll`` files, or an even share of a backlog that would need too many polls.
    """

    spark: SparkSession
    folder: str
    spec: FileSpec
    home: str
    aside: str
    after: str = "LEAVE"
    archive: str | None = None
    tries: int = TRIES
    per_poll: int = PER_POLL
    skip_invalid: bool = False
    log: CommitLog = field(init=False)
    _share: int = field(init=False, default=0)

    def __post_init__(self):
        if self.after not in AFTER:
            raise ValueError(f"unknown treatment {self.after}; known are {', '.join(AFTER)}")
        if self.after in ("ARCHIVE", "MOVE") and not self.archive:
            raise ValueError(f"{self.after} needs a folder")
        self.log = CommitLog(self.spark, self.home)

    def history(self) -> DataFrame:
        """A row per file and try: poll, remote_file_path, attempt, processing_status, error and the run's counters."""
        last = self.log.newest()
        counters = "total_records bigint, successful_records bigint, failed_records bigint, corrected_records bigint, warning_records bigint"
        rows = f"remote_file_path string, attempt int, processing_status string, error string, {counters}, status string, poll int"
        if last < 0:
            return self.spark.createDataFrame([], rows)
        return self.spark.read.schema(rows).option("basePath", f"{self.home}/ledger").parquet(f"{self.home}/ledger/poll=*").filter(F.col("poll") <= last)

    def current(self) -> DataFrame:
        """The newest row of each file."""
        newest = self.history().groupBy("remote_file_path").agg(F.max("attempt").alias("attempt"))
        return self.history().join(newest, ["remote_file_path", "attempt"], "left_semi")

    def pending(self) -> DataFrame:
        """Files of the folder that are new or to be tried again, oldest first, with their tries so far."""
        # what an interrupted poll has moved away is not listed any more
        listing = file_facts(self.spark, f"{self.folder}/", content=False).select("remote_file_path", "remote_last_modified")
        known = self.current().select("remote_file_path", "attempt", "processing_status")
        joined = listing.join(known, "remote_file_path", "left")
        open_ = F.col("processing_status").isNull() | (F.col("processing_status") == "RETRY")
        return joined.filter(open_).select("remote_file_path", F.coalesce("attempt", F.lit(0)).alias("tried"), "remote_last_modified")

    def poll(self) -> int:
        """Takes in the next files; returns how many were tried."""
        number = self.log.newest() + 1
        pending = stored(self.pending(), "pending")
        # the share of a backlog stays until it is taken in, or polls would shrink with it
        self._share = max(self._share, poll_size(self.per_poll, pending.count()))
        queue = pending.orderBy("remote_last_modified", "remote_file_path").limit(self._share)
        tried = {r["remote_file_path"]: r["tried"] for r in queue.collect()}
        if not tried:
            self._share = 0
            return 0
        names = {loadable(f): f for f in tried}
        bad = unreadable(list(names), lambda some: self.spark.read.text(some).agg(F.count(F.lit(1))).collect())
        good = [n for n in names if n not in bad]
        rows = self._outcomes(number, good, names) if good else None
        failed = [
            (names[n], tried[names[n]] + 1, "FAILED" if tried[names[n]] + 1 >= self.tries else "RETRY", reason) for n, reason in bad.items()
        ]
        lost = self.spark.createDataFrame(failed, "remote_file_path string, attempt int, processing_status string, error string")
        if rows is not None:
            taken = [(names[n], tried[names[n]] + 1) for n in good]
            attempts = self.spark.createDataFrame(taken, "remote_file_path string, attempt int")
            lost = lost.unionByName(attempts.join(rows, "remote_file_path"), allowMissingColumns=True)
        lost.write.mode("overwrite").parquet(f"{self.home}/ledger/poll={number}")
        if not self.log.commit(number, {"files": len(tried)}):
            raise RuntimeError("another intake of the same folder is running")
        self._clear([f for f, _, state, _ in failed if state == "FAILED"], [names[n] for n in good])
        return len(tried)

    def _outcomes(self, number: int, good: list[str], names: dict[str, str]) -> DataFrame:
        done = checkpointed(processed(read_records(self.spark, good, self.spec), self.spec, self.skip_invalid))
        run = f"poll-{number}"
        envelopes(route.passing(done), self.spec, run).write.mode("overwrite").parquet(f"{self.home}/events/poll={number}")
        route.quarantined(done).write.mode("overwrite").parquet(f"{self.home}/quarantine/poll={number}")
        files = self.spark.createDataFrame([(names[n],) for n in good], "remote_file_path string")
        counted = files.join(route.summarise(done, ("_file",)).withColumnRenamed("_file", "remote_file_path"), "remote_file_path", "left")
        summary = route.with_status(counted.fillna(0, [c for c in counted.columns if c != "remote_file_path"]))
        state = F.when(F.col("status") == "FAILED", "FAILED").otherwise("PROCESSED")
        return summary.withColumn("processing_status", state)

    def _clear(self, broken: list[str], taken: list[str]) -> None:
        """Moves files after the commit; those a broken poll left behind are known and not taken in again."""
        files = Files(self.spark, self.folder)
        root = files.fs.makeQualified(files.path(self.folder)).toUri().getPath().rstrip("/")

        def below(name: str, to: str) -> str:
            at = files.jvm.java.net.URI(name).getPath()
            return f"{to}/{at.removeprefix(root).lstrip('/')}"

        for name in broken:
            files.move(files.jvm.java.net.URI(name).getPath(), below(name, self.aside))
        for name in taken if self.after != "LEAVE" else ():
            at = files.jvm.java.net.URI(name).getPath()
            if self.after == "DELETE":
                files.delete(at)
            else:
                files.move(at, below(name, self.archive))

    def run(self) -> int:
        """Polls until nothing is left to try; returns the number of polls."""
        polls = 0
        while self.poll():
            polls += 1
        return polls

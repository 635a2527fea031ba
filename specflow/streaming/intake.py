"""File streams into the record run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from specflow.operators.route import passing, quarantined, summarise
from specflow.plans.inbound import processed
from specflow.session import checkpointed
from specflow.sinks.envelope import envelopes
from specflow.sources import read_records
from specflow.sources.lines import loadable
from specflow.spec import FileSpec


def batch_records(batch: DataFrame, spec: FileSpec) -> DataFrame | None:
    """Records of the files of a micro-batch, by the reader of the spec's format, charset and separator.

    A batch has a bounded number of files, and each is in one batch whole, so its numbering is final.
    """
    files = [loadable(r["_file"]) for r in batch.select("_file").distinct().collect()]
    return read_records(batch.sparkSession, files, spec) if files else None


def event_writer(spec: FileSpec, out: str, run_id: str, skip_invalid: bool = False) -> Callable[[DataFrame, int], None]:
    """Per batch of ``sources.poll_files``: events, quarantine rows and file summaries, each overwriting its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        records = batch_records(batch, spec)
        if records is None:
            return
        done = checkpointed(processed(records, spec, skip_invalid))
        envelopes(passing(done), spec, run_id).write.mode("overwrite").parquet(f"{out}/events/batch_no={number}")
        quarantined(done).write.mode("overwrite").parquet(f"{out}/quarantine/batch_no={number}")
        summarise(done, ("_file",)).write.mode("overwrite").parquet(f"{out}/summary/batch_no={number}")

    return each

"""Close of a daily window: collect, deduplicate, reconcile, generate, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.operators import reconcile, windows
from specflow.operators.dedup import judged


@dataclass
class Close:
    accepted: DataFrame
    rejected: DataFrame
    verdicts: DataFrame


def collect(events: DataFrame, frame: DataFrame, ts: str, keys: list[str], event_id: str) -> DataFrame:
    """Events of each window, judged by checksum inside the window."""
    placed = windows.assign(events, ts, frame)
    return judged(placed, ["instance_id", *keys], [ts, event_id], event_id)


def close(collected: DataFrame, expected: DataFrame, percent: float, policy: str = "BLOCK_AND_NOTIFY") -> Close:
    """Accepted events are released only for windows whose count is within tolerance.

    ``expected`` has instance_id and expected_count. The verdict table is small (a row per
    window), yet its join carries no hint: its size decides.
    """
    accepted = collected.filter("accepted")
    actual = accepted.groupBy("instance_id").agg(F.count(F.lit(1)).alias("actual_count"))
    verdicts = reconcile.verdict(reconcile.counts(expected, actual, ["instance_id"]), policy, percent=percent)
    released = verdicts.filter(F.col("verdict").isin("PASS", "WARN")).select("instance_id")
    return Close(accepted.join(released, "instance_id", "left_semi"), collected.filter("not accepted"), verdicts)

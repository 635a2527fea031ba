"""Outcome of ordered action steps, computed over a table of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.operators.ordered import running_sum


def chain_outcome(attempts: DataFrame, group: tuple[str, ...], order: tuple[str, ...], split: int | bool | None = None) -> DataFrame:
    """Adds ``status`` and ``fires_on_error``.

    ``attempts`` has ``succeeded`` and ``continue_on_failure``. The first failed step that
    may not be passed stops its chain: it fires ON_ERROR and all later steps are SKIPPED.
    """
    stops = (~F.col("succeeded") & ~F.col("continue_on_failure")).cast("bigint")
    run = running_sum(attempts.withColumn("_stop", stops), group, order, F.col("_stop"), "_upto", split)
    before = F.col("_upto") - F.col("_stop")
    status = F.when(before > 0, "SKIPPED").when(F.col("succeeded"), "SUCCESS").otherwise("FAILED")
    fires = (before == 0) & (F.col("_stop") == 1)
    return run.withColumns({"status": status, "fires_on_error": fires}).drop("_stop", "_upto")


def outcome_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_duration_ms")
    )

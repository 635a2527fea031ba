"""Expected against actual: completeness checks and control totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict per mismatch policy.
VERDICTS = {"BLOCK_AND_NOTIFY": "BLOCK", "WARN_AND_CONTINUE": "WARN", "FAIL_WINDOW": "FAIL"}


def counts(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of expected_count and actual_count; a missing side counts as 0."""
    zero = F.lit(0).cast("bigint")
    return expected.join(actual, keys, "full_outer").select(
        *keys,
        F.coalesce("expected_count", zero).alias("expected_count"),
        F.coalesce("actual_count", zero).alias("actual_count"),
    )


def within_tolerance(expected: Column, actual: Column, absolute: int = 0, percent: float = 0.0) -> Column:
    """Either allowance is enough."""
    diff = F.abs(actual - expected)
    return (diff <= absolute) | (diff.cast("double") * 100 <= expected.cast("double") * percent)


def verdict(frame: DataFrame, policy: str = "BLOCK_AND_NOTIFY", absolute: int = 0, percent: float = 0.0) -> DataFrame:
    good = within_tolerance(F.col("expected_count"), F.col("actual_count"), absolute, percent)
    return frame.withColumn("verdict", F.when(good, "PASS").otherwise(VERDICTS[policy]))


def control_totals(records: DataFrame, headers: DataFrame, key: str, amount: Column) -> DataFrame:
    """Record count and amount sum per file against the header's declared figures."""
    totals = records.groupBy(key).agg(F.count(F.lit(1)).alias("actual_count"), F.sum(amount).alias("actual_sum"))
    joined = headers.join(totals, key, "left")
    same = (F.col("declared_count") == F.coalesce("actual_count", F.lit(0))) & (
        F.col("declared_sum") == F.coalesce("actual_sum", F.lit(0))
    )
    return joined.withColumn("balanced", same)

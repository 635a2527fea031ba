"""Severity routing, run summaries and issue reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.operators.records import HAS_ERROR, HAS_FATAL, HAS_WARNING, flag


def routed(records: DataFrame, skip_invalid: bool = False) -> DataFrame:
    """Adds ``_route``: FATAL and SKIPPED leave the run, OK and WITH_ERRORS pass."""
    bad = flag(records, HAS_ERROR)
    route = F.when(flag(records, HAS_FATAL), "FATAL").when(bad & F.lit(skip_invalid), "SKIPPED").when(bad, "WITH_ERRORS").otherwise("OK")
    return records.withColumn("_route", route)


def passing(routed_records: DataFrame) -> DataFrame:
    return routed_records.filter(F.col("_route").isin("OK", "WITH_ERRORS"))


def quarantined(routed_records: DataFrame) -> DataFrame:
    return routed_records.filter(F.col("_route").isin("FATAL", "SKIPPED"))


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def summarise(routed_records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run counters. Corrected and warned records count only when they pass."""
    passed = F.col("_route").isin("OK", "WITH_ERRORS")
    return routed_records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        _count(F.col("_route") == "OK").alias("successful_records"),
        _count(~passed).alias("failed_records"),
        _count(passed & F.col("_corrected")).alias("corrected_records"),
        _count(passed & flag(routed_records, HAS_WARNING)).alias("warning_records"),
    )


def with_status(summary: DataFrame) -> DataFrame:
    failed, ok, warned = (F.col(c) > 0 for c in ("failed_records", "successful_records", "warning_records"))
    status = (
        F.when(failed & ok, "COMPLETED_WITH_ERRORS")
        .when(failed, "FAILED")
        .when(warned, "COMPLETED_WITH_WARNINGS")
        .otherwise("COMPLETED")
    )
    return summary.withColumn("status", status)


def with_success_rate(summary: DataFrame) -> DataFrame:
    share = F.col("successful_records").cast("double") / F.col("total_records").cast("double")
    return summary.withColumn("success_rate", F.when(F.col("total_records") > 0, share).otherwise(F.lit(0.0)))


def with_duration(summary: DataFrame, started: Column, completed: Column) -> DataFrame:
    return summary.withColumn("duration_ms", F.unix_millis(completed) - F.unix_millis(started))


def error_details(routed_records: DataFrame) -> DataFrame:
    """Every issue of the records a FATAL removed, as a table."""
    return (
        routed_records.filter(F.col("_route") == "FATAL")
        .select("_file", "_seq", F.explode("_errors").alias("e"))
        .select(
            "_file",
            F.col("_seq").alias("sequence_number"),
            F.col("e.field").alias("field"),
            F.col("e.message").alias("message"),
            F.col("e.severity").alias("severity"),
        )
    )


def issues_by_rule(records: DataFrame) -> DataFrame:
    return (
        records.select(F.explode(F.concat("_errors", "_warnings")).alias("e"))
        .groupBy(
            F.col("e.field").alias("field"),
            F.coalesce("e.rule_id", F.lit("-")).alias("rule_id"),
            F.col("e.severity").alias("severity"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def corrections_by_type(records: DataFrame) -> DataFrame:
    return (
        records.select(F.explode("_corrections").alias("c"))
        .groupBy(F.col("c.field").alias("field"), F.col("c.type").alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

"""Files to records to events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.operators import coerce, route
from specflow.operators.correct import apply_corrections
from specflow.operators.records import FLAGS, flags_of_issues, value_of
from specflow.operators.validate import apply_validations
from specflow.session import checkpointed
from specflow.sinks.envelope import envelopes, new_run_id
from specflow.sources import read_records
from specflow.spec import FileSpec


def check_patterns(spark: SparkSession, spec: FileSpec) -> None:
    """Fails before any data is read when a pattern or expression of the spec does not compile."""
    patterns = [r.value for r in spec.validation_rules if r.rule_type == "REGEX" and r.value is not None]
    patterns += [f.validation_regex for f in spec.fields if f.validation_regex is not None]
    if patterns:
        one = spark.range(1).select(*[F.lit("").rlike(p).alias(f"p{i}") for i, p in enumerate(patterns)])
        one.collect()


def recheck_types(records: DataFrame, spec: FileSpec) -> DataFrame:
    """Drops conversion issues of values that a correction has since repaired (opt-in)."""

    def stale(e: Column) -> Column:
        conversion = F.startswith(e["message"], F.lit("Cannot convert")) | F.startswith(
            e["message"], F.lit("Type conversion")
        )
        return e["rule_id"].isNull() & conversion & _fixed(e, spec)

    kept = records.withColumn("_errors", F.filter("_errors", lambda e: ~stale(e)))
    return kept.withColumn(FLAGS, flags_of_issues())


def _fixed(e: Column, spec: FileSpec) -> Column:
    hit = F.lit(False)
    for f in spec.fields:
        if coerce.spark_type(f) != "string":
            hit = hit | ((e["field"] == f.name) & coerce.typed(f, value_of(f.name)).isNotNull())
    return hit


def processed(parsed: DataFrame, spec: FileSpec, skip_invalid: bool = False) -> DataFrame:
    """Correct, validate, route. Parse issues stay even when a correction repairs the value."""
    corrected = apply_corrections(parsed, spec)
    if spec.recoerce_after_correction:
        corrected = recheck_types(corrected, spec)
    return route.routed(apply_validations(corrected, spec), skip_invalid)


@dataclass
class RunResult:
    records: DataFrame
    passed: DataFrame
    quarantine: DataFrame
    summary: DataFrame
    errors: DataFrame
    run_id: str


def run_files(spark: SparkSession, paths: str | list[str], spec: FileSpec, skip_invalid: bool = False,
              filters: list[str] | None = None, store: bool = True) -> RunResult:
    """Reads, processes and splits files. With ``store`` the records are evaluated once and
    kept in the shared folder, so the outputs below do not re-read the files."""
    check_patterns(spark, spec)
    done = processed(read_records(spark, paths, spec, filters), spec, skip_invalid)
    return split_run(checkpointed(done) if store else done)


def split_run(done: DataFrame) -> RunResult:
    return RunResult(
        records=done,
        passed=route.passing(done),
        quarantine=route.quarantined(done),
        summary=route.with_success_rate(route.with_status(route.summarise(done, ("_file",)))),
        errors=route.error_details(done),
        run_id=new_run_id(),
    )


def events(done: DataFrame, spec: FileSpec, run_id: str, **options) -> DataFrame:
    """Event rows of the records that pass."""
    return envelopes(route.passing(done), spec, run_id, **options)


def dry_run(parsed: DataFrame, spec: FileSpec, skip_invalid: bool = False) -> DataFrame:
    """Summary of a run that writes nothing."""
    done = processed(parsed, spec, skip_invalid)
    return route.with_success_rate(route.with_status(route.summarise(done)))


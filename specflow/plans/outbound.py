"""Records or events to output lines and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import templates
from specflow.operators import route
from specflow.operators.correct import apply_corrections
from specflow.operators.mapping import map_fields, outbound_spec
from specflow.operators.records import FLAGS, flags_of_issues, value_of
from specflow.operators.validate import apply_validations
from specflow.sinks import generators
from specflow.spec import FileSpec


def mapped_records(records: DataFrame, spec: FileSpec, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Map, correct, validate and route with the outbound rules; FATAL records drop out.

    So do records with values that a line of the output format cannot hold.
    """
    config = spec.outbound
    target = outbound_spec(spec)
    done = map_fields(records, config.field_mappings, config.field_order, keep)
    checked = apply_validations(apply_corrections(done, target), target)
    odd = generators.misfits(config.format, field_order(spec), **options)
    errors = F.filter(odd, lambda i: i.severity != "WARNING")
    warnings = F.filter(odd, lambda i: i.severity == "WARNING")
    told = F.col(FLAGS).bitwiseOR(flags_of_issues(errors, warnings))
    checked = checked.withColumns({"_errors": F.concat("_errors", errors), "_warnings": F.concat("_warnings", warnings), FLAGS: told})
    return route.routed(checked)


def field_order(spec: FileSpec) -> list[str]:
    config = spec.outbound
    names = [m.target_field for m in config.field_mappings]
    return [n for n in config.field_order if n in names] + [n for n in names if n not in config.field_order]


@dataclass
class OutboundRun:
    routed: DataFrame
    lines: DataFrame
    summary: DataFrame


def generate(records: DataFrame, spec: FileSpec, order: tuple[str, ...], batch_size: int = 10_000,
             keep: tuple[str, ...] = (), split: int | bool | None = None, **options) -> OutboundRun:
    """Detail lines in files of at most ``batch_size`` records per aggregation key."""
    config = spec.outbound
    done = mapped_records(records, spec, keep=tuple(dict.fromkeys((*keep, *[o for o in order if o not in ("_seq", "_file")]))), **options)
    passed = route.passing(done)
    group: tuple[str, ...] = ()
    if config.aggregation_key:
        passed = passed.withColumn("file_key", value_of(config.aggregation_key))
        group = ("file_key",)
    placed = generators.split_files(passed, group, order, batch_size, split)
    fmt = config.format
    if fmt in ("CSV", "DELIMITED"):
        options.setdefault("delimiter", config.delimiter or ",")
    options.pop("line_breaks", None)
    line = generators.line_of(fmt, field_order(spec), **options)
    return OutboundRun(done, placed.withColumn("line", line), run_summary(done, spec))


def run_summary(done: DataFrame, spec: FileSpec) -> DataFrame:
    return done.agg(
        F.count_if(F.col("_route") != "FATAL").alias("processed_records"),
        F.count_if(F.col("_route") == "FATAL").alias("failed_records"),
    )


def file_name(spec: FileSpec, at: Column, extra: dict[str, Column | str] | None = None) -> Column:
    config = spec.outbound
    values = {"specId": spec.id, "ext": templates.EXTENSIONS.get(config.format, "dat"), **templates.date_parts(at)}
    values.update(extra or {})
    return templates.render(config.file_naming_pattern, values)

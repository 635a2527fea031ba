"""One file layout to another: parse, correct, validate, map, generate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.operators import route
from specflow.operators.mapping import map_fields
from specflow.plans.inbound import processed
from specflow.sinks import generators
from specflow.spec import FileSpec, SpecError


def convert(parsed: DataFrame, spec: FileSpec, skip_invalid: bool = False, **options) -> DataFrame:
    """Output lines of the records that pass, per input file and sequence number."""
    target = spec.output_spec
    if target is None:
        raise SpecError(f"spec '{spec.name}' has no output section")
    passed = route.passing(processed(parsed, spec, skip_invalid))
    names = [f.name for f in spec.fields]
    if target.field_mappings:
        passed = map_fields(passed, target.field_mappings)
        names = [m.target_field for m in target.field_mappings]
    if target.format in ("CSV", "DELIMITED"):
        options.setdefault("delimiter", target.delimiter or ",")
    line = generators.line_of(target.format, names, **options)
    return passed.select("_file", "_seq", line.alias("line"))


def with_header(lines: DataFrame, spec: FileSpec) -> DataFrame:
    """Adds a header line per file, placed before sequence 0."""
    target = spec.output_spec
    names = [m.target_field for m in target.field_mappings] or [f.name for f in spec.fields]
    header = generators.csv_header(names, target.delimiter or ",")
    heads = lines.select("_file").distinct().select(
        "_file", F.lit(-1).cast("bigint").alias("_seq"), F.lit(header).alias("line")
    )
    return lines.unionByName(heads)

"""Readers by format, and the hook for new ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specflow.sources.delimited import parse_delimited
from specflow.sources.fixed_width import parse_fixed_width
from specflow.sources.json_records import read_json
from specflow.sources.lines import number_lines, read_lines
from specflow.sources.listing import glob_of
from specflow.sources.payments import nacha_entries, read_x12, swift_records
from specflow.sources.xml_records import read_xml
from specflow.spec import FileSpec, UnsupportedFormatError, require_valid

Reader = Callable[[SparkSession, list[str], FileSpec, str | None], DataFrame]
_readers: dict[str, Reader] = {}


def register_reader(format_name: str, reader: Reader) -> None:
    _readers[format_name] = reader


def supported_formats() -> list[str]:
    return sorted(_readers)


def read_records(spark: SparkSession, paths: str | list[str], spec: FileSpec, filters: list[str] | None = None) -> DataFrame:
    """Records of all files under the paths; ``filters`` are file-name patterns."""
    if spec.format not in _readers:
        raise UnsupportedFormatError(f"no reader for format {spec.format}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _readers[spec.format](spark, paths, spec, glob_of(filters) if filters else None)


def _data_lines(spark, paths, spec, glob) -> DataFrame:
    lines = read_lines(spark, paths, spec.encoding, spec.record_separator, glob)
    return number_lines(lines, spec.skip_lines_count, spec.has_header)[0]


def _delimited(spark, paths, spec, glob):
    require_valid(spec)
    return parse_delimited(_data_lines(spark, paths, spec, glob), spec)


def _fixed(spark, paths, spec, glob):
    require_valid(spec)
    return parse_fixed_width(_data_lines(spark, paths, spec, glob), spec)


def _json(spark, paths, spec, glob):
    return read_json(spark, paths, spec, glob)


def _nacha(spark, paths, spec, glob):
    return nacha_entries(_data_lines(spark, paths, spec, glob), spec if spec.fields else None).drop("_batch")


def _swift(spark, paths, spec, glob):
    lines = read_lines(spark, paths, spec.encoding, "-}", glob)
    return swift_records(number_lines(lines)[0], spec)


def _x12(spark, paths, spec, glob):
    require_valid(spec)
    return read_x12(spark, paths, spec, glob)


def _xml(spark, paths, spec, glob):
    return read_xml(spark, paths, spec, glob)


for _format, _reader in {
    "CSV": _delimited,
    "DELIMITED": _delimited,
    "FIXED_WIDTH": _fixed,
    "JSON": _json,
    "NACHA": _nacha,
    "SWIFT_MT": _swift,
    "EDI_X12": _x12,
    "XML": _xml,
    "ISO20022": _xml,
}.items():
    register_reader(_format, _reader)

"""Output lines per format, with headers, control records and bounded files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import templates, text
from specflow.operators.ordered import row_numbers
from specflow.operators.records import ISSUES, collected, fcol, found, issue, literal, ticked, value_of
from specflow.spec import UnsupportedFormatError

Generator = Callable[..., Column]
_generators: dict[str, Generator] = {}

BLOCK_LINES = 10  # lines per block in bank files
DEBIT_CODES = ("27", "37", "027", "037")


def register_generator(format_name: str, build: Generator) -> None:
    """``build(fields, **options)`` returns the line of one record as a column."""
    _generators[format_name] = build


def line_of(format_name: str, fields: list[str], **options) -> Column:
    if format_name not in _generators:
        raise UnsupportedFormatError(f"no generator for format {format_name}")
    return _generators[format_name](fields, **options)


def csv_cell(c: Column, delimiter: str) -> Column:
    """Quoted when the text holds the delimiter, a quote or a line break; quotes inside are doubled."""
    whole = F.coalesce(c, F.lit(""))
    doubled = F.concat(F.lit('"'), F.replace(whole, F.lit('"'), F.lit('""')), F.lit('"'))
    marks = [F.contains(whole, F.lit(mark)) for mark in (delimiter, '"', "\n", "\r")]
    return F.when(marks[0] | marks[1] | marks[2] | marks[3], doubled).otherwise(whole)


def csv_line(fields: list[str], delimiter: str = ",", value=value_of) -> Column:
    return F.concat_ws(delimiter, *[csv_cell(value(n), delimiter) for n in fields])


def csv_header(fields: list[str], delimiter: str = ",") -> str:
    return delimiter.join(fields)


def fixed_line(fields: list[str], widths: dict[str, int], numeric: set[str] = frozenset(), value=value_of) -> Column:
    """Numbers padded with zeros on the left and never cut; text padded with spaces on the right and cut to width.

    ``misfits`` reports what is too wide; records with a number that is must not be written.
    """
    cells = []
    for n in fields:
        c = F.coalesce(value(n), F.lit(""))
        cells.append(text.pad_left(c, widths[n]) if n in numeric else F.substring(text.pad_right(c, widths[n]), 1, widths[n]))
    return F.concat(*cells)


def misfits(format_name: str, fields: list[str], widths: dict[str, int] | None = None, numeric: set[str] = frozenset(),
            line_breaks: bool = False, **_) -> Column:
    """Issues of the values that a line of the format cannot hold.

    Numbers wider than their column are FATAL, text that will be cut is a WARNING. Line breaks
    are FATAL in line formats unless ``line_breaks`` says that the reader takes quoted ones.
    """
    hits = []
    for n in fields:
        value, raw = value_of(n), f"cast({ticked(fcol(n))} as string)"
        if format_name in ("FIXED_WIDTH", "NACHA"):
            severity = "FATAL" if n in numeric else "WARNING"
            hits.append(found(F.coalesce(F.length(value) > widths[n], F.lit(False)), issue(n, literal(f"wider than {widths[n]}"), severity, raw)))
        if format_name in ("FIXED_WIDTH", "NACHA") or format_name in ("CSV", "DELIMITED") and not line_breaks:
            hits.append(found(F.coalesce(value.rlike(r"[\r\n]"), F.lit(False)), issue(n, literal("holds a line break"), "FATAL", raw)))
    return collected(hits, ISSUES)


def json_line(fields: list[str], value=value_of) -> Column:
    return F.to_json(F.struct(*[value(n).alias(n) for n in fields]), {"ignoreNullFields": "false"})


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def xml_line(fields: list[str], tag: str = "record", value=value_of) -> Column:
    parts = [F.lit(f"<{tag}>")]
    for n in fields:
        element = F.concat(F.lit(f"<{n}>"), xml_escape(value(n)), F.lit(f"</{n}>"))
        parts.append(F.coalesce(element, F.lit("")))
    return F.concat(*parts, F.lit(f"</{tag}>"))


def swift_line(fields: list[str], tags: dict[str, str] | None = None, value=value_of) -> Column:
    """One message: header block, tagged lines, end mark."""
    tags = tags or {n: n for n in fields}
    lines = [F.concat(F.lit(f":{tags[n]}:"), value(n)) for n in fields]
    return F.concat(F.lit("{4:\n"), F.concat_ws("\n", *lines), F.lit("\n-}"))


for _name, _build in {
    "CSV": csv_line, "DELIMITED": csv_line, "FIXED_WIDTH": fixed_line, "NACHA": fixed_line,
    "JSON": json_line, "XML": xml_line, "SWIFT_MT": swift_line,
}.items():
    register_generator(_name, _build)


def split_files(records: DataFrame, group: tuple[str, ...], order: tuple[str, ...], batch_size: int,
                split: int | bool | None = None) -> DataFrame:
    """Adds ``file_no`` (from 0 per group) and ``line_no`` (from 1 per file): no file exceeds the batch size."""
    numbered = row_numbers(records, group, order, "_rn", split)
    return numbered.select(
        "*",
        F.floor((F.col("_rn") - 1) / batch_size).cast("bigint").alias("file_no"),
        ((F.col("_rn") - 1) % batch_size + 1).alias("line_no"),
    ).drop("_rn")


def totals(records: DataFrame, keys: list[str], amount: Column, code: Column, routing: Column) -> DataFrame:
    """Control figures per file: entries, debit and credit sums, routing hash, blocks."""
    debit = F.when(code.isin(*DEBIT_CODES), amount).otherwise(0)
    credit = F.when(code.isin(*DEBIT_CODES), 0).otherwise(amount)
    summed = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entryCount"),
        F.sum(debit).alias("totalDebit"),
        F.sum(credit).alias("totalCredit"),
        (F.sum(F.substring(routing, 1, 8).try_cast("bigint")) % 10_000_000_000).alias("entryHash"),
    )
    # the two header and the two control lines count towards the blocks
    blocks = F.ceil((F.col("entryCount") + 4) / BLOCK_LINES)
    return summed.withColumn("batchCount", F.lit(1).cast("bigint")).withColumn("blockCount", blocks.cast("bigint"))


NUMERIC_TOTALS = {"batchCount", "blockCount", "entryCount", "totalDebit", "totalCredit", "entryHash"}


def framed(details: DataFrame, summary: DataFrame, keys: list[str], header: str | None, footer: str | None,
           constants: dict[str, Column | str] | None = None) -> DataFrame:
    """Header, detail and footer lines per file, with ``line_no`` for the final sort.

    ``details`` has keys, line_no (from 1) and line; ``summary`` has one row per file.
    Headers take line 0 and footers the line after the last detail: a union, no join.
    """
    values = {c: F.col(c) for c in summary.columns}
    values.update(constants or {})
    parts = [details.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), "line")]
    if header is not None:
        top = templates.render(header, values, NUMERIC_TOTALS)
        parts.append(summary.select(*keys, F.lit(0).cast("bigint").alias("line_no"), top.alias("line")))
    if footer is not None:
        end = templates.render(footer, values, NUMERIC_TOTALS)
        parts.append(summary.select(*keys, (F.col("entryCount") + 1).cast("bigint").alias("line_no"), end.alias("line")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def with_empty_policy(summary: DataFrame, calendar: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """Which files exist when some have no records.

    SKIP drops them; GENERATE_EMPTY keeps them with a header only; GENERATE_TRAILER keeps
    them with a footer only. Adds has_header and has_footer.
    """
    zero = F.lit(0)
    figures = [c for c in summary.columns if c not in keys]
    filled = calendar.join(summary, keys, "left").select(*keys, *[F.coalesce(c, zero).alias(c) for c in figures])
    empty = F.col("entryCount") == 0
    if policy == "SKIP":
        filled = filled.filter(~empty)
    return filled.select(
        "*",
        (~empty | F.lit(policy == "GENERATE_EMPTY")).alias("has_header"),
        (~empty | F.lit(policy == "GENERATE_TRAILER")).alias("has_footer"),
    )

"""Delimited lines to records."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import text
from specflow.operators.coerce import Coerced, Extra, coerce
from specflow.operators.records import (
    FLAGS, ISSUES, case_of, collected, fcol, flags, pinned, quoted, start_columns,
)
from specflow.spec import FileSpec, require_valid


#: stands for a delimiter outside quotes; no character by the standard, so lines with it are rare
MARK = "\ufdd0"


def split_quoted(line: Column, delimiter: str) -> Column:
    """Split outside quotes; quotes toggle and vanish, a doubled quote leaves nothing.

    Pieces between quotes alternate outside/inside. Delimiters of the outer pieces become a mark, the
    pieces are joined and cut at the marks: each character is copied a fixed number of times.
    """
    pattern = r"\Q" + delimiter + r"\E"
    pieces = F.split(line, '"', -1)
    marked = F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, piece).otherwise(F.replace(piece, F.lit(delimiter), F.lit(MARK))))
    cells = F.split(F.array_join(marked, ""), MARK, -1)
    quotes = F.contains(line, F.lit('"'))
    return F.when(quotes & F.contains(line, F.lit(MARK)), _glued(pieces, pattern)).when(quotes, cells).otherwise(F.split(line, pattern, -1))


def _glued(pieces: Column, pattern: str) -> Column:
    """The same without a mark: the first cell of a piece continues the last cell so far."""
    parts = F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, F.array(piece)).otherwise(F.split(piece, pattern, -1)))

    def glue(cells: Column, more: Column) -> Column:
        seam = F.concat(F.element_at(cells, -1), F.element_at(more, 1))
        return F.concat(F.slice(cells, F.lit(1), F.size(cells) - 1), F.array(seam), F.slice(more, F.lit(2), F.size(more)))

    return F.aggregate(parts, F.array(F.lit("")), glue)


def header_names(header: Column, delimiter: str) -> Column:
    """Header cells: split without regard to quotes, trimmed, lower case."""
    return F.transform(F.split(header, r"\Q" + delimiter + r"\E", -1), lambda c: F.lower(text.trim(c)))


def column_indexes(header: Column, spec: FileSpec) -> Column:
    """Per field its 0-based place, null when the header lacks it; the last duplicate wins."""
    names = header_names(header, spec.delimiter or ",")
    places = []
    for f in spec.fields:
        if f.column_index is not None:
            places.append(F.lit(f.column_index))
        elif f.column_name is not None:
            back = F.array_position(F.reverse(names), F.lit(f.column_name.lower())).cast("int")
            places.append(F.when(back > 0, F.size(names) - back))
        else:
            places.append(F.lit(None).cast("int"))
    return F.array(*places).cast("array<int>")


def static_indexes(spec: FileSpec, header: str | None = None) -> list[int | None]:
    """Places known before the job: by index, or by one header that all lines share."""
    names = {}
    if header is not None:
        for i, cell in enumerate(header.split(spec.delimiter or ",")):
            names[cell.strip().lower()] = i
    return [
        f.column_index if f.column_index is not None else names.get((f.column_name or "").lower())
        for f in spec.fields
    ]


def parse_delimited(
    lines: DataFrame, spec: FileSpec, header: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``lines`` has _file, _seq, _raw and, for per-file headers, _header; ``keep`` rides along."""
    require_valid(spec)
    parts = split_quoted(F.col("_raw"), spec.delimiter or ",")
    service = ["_file", "_seq", "_raw", *keep]
    odd = text.has_odd_space(F.col("_raw"))
    if "_header" in lines.columns and header is None:
        split = lines.select(
            *service, column_indexes(F.col("_header"), spec).alias("_places"), parts.alias("_parts"), odd.alias("_odd")
        )
        places = [F.get("_places", F.lit(k)) for k in range(len(spec.fields))]
        raws = [F.get("_parts", p) for p in places]
        gone = [p.isNull() for p in places]
    else:
        split = lines.select(*service, parts.alias("_parts"), odd.alias("_odd"))
        static = static_indexes(spec, header)
        raws = [F.lit(None).cast("string") if i is None else F.get("_parts", F.lit(i)) for i in static]
        gone = [F.lit(i is None) for i in static]
    cells = split.select(
        *service,
        *[text.trim_known(r, F.col("_odd")).alias(f"_r{k}") for k, r in enumerate(raws)],
        *[g.alias(f"_g{k}") for k, g in enumerate(gone)],
    )
    made = [coerce(f, f"_r{k}", F.col(f"_g{k}")) for k, f in enumerate(spec.fields)]
    return finish(cells, spec, made, keep)


def finish(cells: DataFrame, spec: FileSpec, made: list[Coerced], keep: tuple[str, ...] = (), more: tuple[Extra, ...] = ()) -> DataFrame:
    """The record frame. What is wrong with a record is a code per field first; its issues are built from
    these for the rows and by the plans that read them. ``more`` are issues of the record as a whole.

    Each code is a column, as Spark cuts generated code between columns; one expression of all codes
    would be a method too large to be compiled.
    """
    declared = [f.name for f in spec.fields]
    extra = [n for n in spec.record_fields if n not in declared]
    codes = [c.code for c in made] + [F.when(e.bad, 1).otherwise(0) for e in more]
    names = [f"_code{k}" for k in range(len(codes))]
    records = cells.select(
        "_file",
        "_seq",
        "_raw",
        *[c.value.alias(fcol(n)) for c, n in zip(made, declared)],
        *[F.lit(None).cast("string").alias(fcol(n)) for n in extra],
        *[c.alias(n) for c, n in zip(codes, names)],
        F.create_map().cast("map<string,string>").alias("_metadata"),
        *keep,
    )
    once = pinned(records, [*[fcol(n) for n in declared], *names])
    cases = [c.issues for c in made] + [{1: e.issue} for e in more]
    issues = [case_of(F.col(n), own) for n, own in zip(names, cases)]
    wrong = reduce(or_, [F.col(n) != 0 for n, own in zip(names, cases) if own], F.lit(False))
    fatal = reduce(or_, [F.col(n) != 0 for n, e in zip(names[len(made):], more) if e.fatal], F.lit(False))
    return once.select(
        "_file", "_seq", "_raw", *[quoted(fcol(n)) for n in [*declared, *extra]],
        collected(issues[len(made):] + issues[: len(made)], ISSUES).alias("_errors"), *start_columns(), "_metadata",
        flags(wrong, fatal).alias(FLAGS), *keep,
    )

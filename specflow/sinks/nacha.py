"""Bank files in the public 94-column layout: headers, entries, controls and filler lines.

Each file holds one batch. Every part is a column of fixed-width cells; the file is their
union with a line number, so no file is gathered in one row or task before it is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import text
from specflow.operators.records import ISSUES, collected, found, issue, literal, ticked
from specflow.sinks.generators import BLOCK_LINES, DEBIT_CODES

LINE = 94
#: lines of a file beside its entries: two headers and two controls
FRAME = 4

# Cells of each record type as (name or fixed text, width, N numeric or A text).
FILE_HEADER = (("'1'", 1, "A"), ("'01'", 2, "A"), ("destination", 10, "R"), ("origin", 10, "R"), ("created_on", 6, "A"),
               ("created_at", 4, "A"), ("modifier", 1, "A"), ("'094'", 3, "A"), ("'10'", 2, "A"), ("'1'", 1, "A"),
               ("destination_name", 23, "A"), ("origin_name", 23, "A"), ("reference", 8, "A"))
BATCH_HEADER = (("'5'", 1, "A"), ("service_class", 3, "N"), ("company_name", 16, "A"), ("company_data", 20, "A"),
                ("company_id", 10, "A"), ("entry_class", 3, "A"), ("description", 10, "A"), ("described_on", 6, "A"),
                ("effective_on", 6, "A"), ("''", 3, "A"), ("'1'", 1, "A"), ("originator", 8, "N"), ("batch_no", 7, "N"))
ENTRY = (("'6'", 1, "A"), ("code", 2, "N"), ("routing", 9, "N"), ("account", 17, "A"), ("cents", 10, "N"), ("individual_id", 15, "A"),
         ("individual_name", 22, "A"), ("''", 2, "A"), ("'0'", 1, "A"), ("originator", 8, "N"), ("trace_no", 7, "N"))
BATCH_CONTROL = (("'8'", 1, "A"), ("service_class", 3, "N"), ("entryCount", 6, "N"), ("entryHash", 10, "N"), ("totalDebit", 12, "N"),
                 ("totalCredit", 12, "N"), ("company_id", 10, "A"), ("''", 19, "A"), ("''", 6, "A"), ("originator", 8, "N"), ("batch_no", 7, "N"))
FILE_CONTROL = (("'9'", 1, "A"), ("batchCount", 6, "N"), ("blockCount", 6, "N"), ("entryCount", 8, "N"), ("entryHash", 10, "N"),
                ("totalDebit", 12, "N"), ("totalCredit", 12, "N"), ("''", 39, "A"))

Layout = Sequence[tuple[str, int, str]]


def line(layout: Layout, constants: dict[str, str] | None = None) -> Column:
    """One record: numbers with zeros on the left and never cut, text cut and filled with spaces."""
    cells = []
    for name, width, kind in layout:
        if name.startswith("'"):
            value = F.lit(name.strip("'"))
        elif constants and name in constants:
            value = F.lit(constants[name])
        else:
            value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if kind == "N":
            cells.append(text.pad_left(value, width))
        else:
            padded = text.pad_left(value, width, " ") if kind == "R" else text.pad_right(value, width)
            cells.append(F.substring(padded, 1, width))
    return F.concat(*cells)


def unfit(layout: Layout = ENTRY) -> Column:
    """FATAL issues of numbers that are wider than their cells; such records must not be written."""
    hits = []
    for name, width, kind in layout:
        if kind == "N" and not name.startswith("'"):
            shown = f"cast({ticked(name)} as string)"
            wide = F.coalesce(F.length(F.col(name).cast("string")) > width, F.lit(False))
            hits.append(found(wide, issue(name, literal(f"wider than {width}"), "FATAL", shown)))
    return collected(hits, ISSUES)


def totals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Control figures per file; the hash keeps the last ten digits of the sum of the bank numbers."""
    debit = F.when(F.col("code").isin(*DEBIT_CODES), F.col("cents")).otherwise(0)
    figures = entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entryCount"),
        F.sum(debit).alias("totalDebit"),
        (F.sum("cents") - F.sum(debit)).alias("totalCredit"),
        (F.sum(F.substring("routing", 1, 8).try_cast("bigint")) % 10_000_000_000).alias("entryHash"),
    )
    blocks = F.ceil((F.col("entryCount") + FRAME) / BLOCK_LINES).cast("bigint")
    return figures.withColumn("batchCount", F.lit(1).cast("bigint")).withColumn("blockCount", blocks)


def files(entries: DataFrame, keys: list[str], number: str, constants: dict[str, str]) -> DataFrame:
    """keys, line_no and line of whole files. ``number`` counts the entries of a file from 1.

    ``constants`` gives every cell that is neither a column of the entries nor a control figure.
    """
    figures = totals(entries, keys)
    at = F.col("entryCount")

    def of(frame: DataFrame, place: Column, made: Column) -> DataFrame:
        return frame.select(*keys, place.cast("bigint").alias("line_no"), made.alias("line"))

    numbered = entries.withColumn("trace_no", F.col(number))
    fillers = figures.filter(F.pmod(at + FRAME, F.lit(BLOCK_LINES)) != 0).withColumn(
        "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), BLOCK_LINES - 1 - F.pmod(at + FRAME, F.lit(BLOCK_LINES)))))
    parts = [
        of(figures, F.lit(0), line(FILE_HEADER, constants)),
        of(figures, F.lit(1), line(BATCH_HEADER, constants)),
        of(numbered, F.col(number) + 1, line(ENTRY, constants)),
        of(figures, at + 2, line(BATCH_CONTROL, constants)),
        of(figures, at + 3, line(FILE_CONTROL, constants)),
        of(fillers, at + FRAME + F.col("_n"), F.lit("9" * LINE)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole

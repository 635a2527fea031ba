"""The record frame: fixed service columns plus one string column per field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "struct<field:string,message:string,severity:string,raw_value:string,rule_id:string>"
ISSUES = f"array<{ISSUE}>"
#: bits that tell what a record has, so that routes and counters need not build its issues
FLAGS = "_flags"
HAS_ERROR, HAS_FATAL, HAS_WARNING = 1, 2, 4
CHANGES = "array<struct<field:string,original:string,corrected:string,type:string>>"
SERVICE = ("_file", "_seq", "_raw", "_errors", "_warnings", "_corrected", "_corrections", "_metadata", "_flags")


def fcol(name: str) -> str:
    return f"f_{name}"


def ticked(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(ticked(name))


def value_of(name: str) -> Column:
    return quoted(fcol(name))


def text(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def literal(value: str | None) -> str:
    """SQL text of a string literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def issue(field: str, message: str, severity: str, raw: str = "cast(null as string)", rule_id: str | None = None) -> Column:
    """A one-element issue array. ``message`` and ``raw`` are SQL text, so one call builds the lot."""
    return F.expr(
        f"array(named_struct('field', {literal(field)}, 'message', {message}, 'severity', {literal(severity)}, "
        f"'raw_value', {raw}, 'rule_id', {literal(rule_id)}))"
    )


def found(condition: Column, hit: Column) -> Column:
    return F.when(condition, hit).otherwise(F.expr(f"cast(array() as {ISSUES})"))


def collected(items: list[Column], kind: str) -> Column:
    """One array from arrays of zero or one element. Plain concat keeps the work in generated code."""
    return F.concat(*items) if items else F.array().cast(kind)


def pinned(df: DataFrame, names: list[str]) -> DataFrame:
    """Evaluates the named columns once per row.

    Catalyst pushes filters through projections by copying the expressions they read;
    with layered rules those copies multiply. A one-row generator is a border it does
    not cross, so later filters and explodes read finished values. It costs no shuffle.
    """
    rest = [quoted(c) for c in df.columns if c not in names]
    once = df.select(*rest, F.inline(F.array(F.struct(*[quoted(n) for n in names]))))
    return once.select(*[quoted(c) for c in df.columns])


def case_of(code: Column, issues: dict[int, Column]) -> Column:
    """The issue array that belongs to a code; none for others."""
    nothing = F.expr(f"cast(array() as {ISSUES})")
    return reduce(lambda so_far, item: so_far.when(code == item[0], item[1]), issues.items(), F.when(F.lit(False), nothing)).otherwise(nothing)


def flags(error: Column, fatal: Column | None = None, warning: Column | None = None) -> Column:
    """The flags of what holds."""
    out = F.when(error, HAS_ERROR).otherwise(0)
    if fatal is not None:
        out = out.bitwiseOR(F.when(fatal, HAS_FATAL).otherwise(0))
    return out if warning is None else out.bitwiseOR(F.when(warning, HAS_WARNING).otherwise(0))


def flags_of_issues(errors: Column | str = "_errors", warnings: Column | str = "_warnings") -> Column:
    """The flags as the issues themselves tell them."""
    return flags(F.size(errors) > 0, F.exists(errors, lambda e: e["severity"] == "FATAL"), F.size(warnings) > 0)


def flag(records: DataFrame, which: int) -> Column:
    """Whether a record has errors, fatal ones or warnings; frames made without flags are asked for their issues."""
    known = F.col(FLAGS) if FLAGS in records.columns else flags_of_issues()
    return known.bitwiseAND(which) != 0


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def start_columns() -> list[Column]:
    """Service columns of a record nothing has happened to yet."""
    return [
        no_issues().alias("_warnings"),
        F.lit(False).alias("_corrected"),
        F.array().cast(CHANGES).alias("_corrections"),
    ]


def from_columns(df: DataFrame, spec, seq: str | None = None, file: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Records whose fields already sit in columns named like the spec's fields."""
    empty = F.create_map().cast("map<string,string>")
    have = set(df.columns)
    return df.select(
        (file if file is not None else F.lit(None).cast("string")).alias("_file"),
        (F.col(seq).cast("bigint") if seq else F.lit(None).cast("bigint")).alias("_seq"),
        F.lit(None).cast("string").alias("_raw"),
        *[
            (text(quoted(n)) if n in have else F.lit(None).cast("string")).alias(fcol(n))
            for n in spec.record_fields
        ],
        no_issues().alias("_errors"),
        *start_columns(),
        (metadata if metadata is not None else empty).alias("_metadata"),
        F.lit(0).alias(FLAGS),
    )


def attach_metadata(records: DataFrame, entries: dict[str, Column | str]) -> DataFrame:
    pairs = [part for k, v in entries.items() for part in (F.lit(k), text(v))]
    return records.withColumn("_metadata", F.map_concat("_metadata", F.create_map(*pairs)))


def read_metadata(key: str) -> Column:
    return F.element_at("_metadata", key)


def was_corrected(name: str) -> Column:
    return F.exists("_corrections", lambda c: c["field"] == name)

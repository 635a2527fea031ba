"""Type coercion to the canonical string view, with one issue per bad value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import masking, text
from specflow.operators.records import fcol, issue, literal, ticked
from specflow.spec import FieldSpec, FileSpec

# What counts as true in delimited text (any case) and in fixed-width text (exact).
TRUE_DELIMITED = ("true", "1", "yes", "y")
TRUE_FIXED = ("1", "Y", "T", "true")

# Types whose text can fail to convert.
CHECKED = ("INTEGER", "LONG", "DECIMAL", "AMOUNT")

# Issue wordings users match on.
MISSING_COLUMN = "Column '{column}' not found in header"
REQUIRED_DELIMITED = "Required field '{name}' is missing or empty"
REQUIRED_FIXED = "Required field '{name}' is blank"
REQUIRED_XML = "Required XML field '{name}' not found at path '{path}'"
CONVERSION_DELIMITED = ("Cannot convert '{name}' value '", "' to {type}")
CONVERSION_FIXED = ("Type conversion failed for '{name}': '", "' is not {type}")
SHORT_LINE = "Line too short to extract field '{name}' at position {position}"


#: codes of a field: what is wrong with its cell
GONE, BLANK, UNREADABLE, NULL = 1, 2, 3, 4


@dataclass
class Coerced:
    """A field's value, the code of what is wrong with its cell (0: nothing) and the issue of each code.

    Issues are expressions over the finished record.
    """

    value: Column
    code: Column
    issues: dict[int, Column]


@dataclass
class Extra:
    """An issue of a record as a whole."""

    bad: Column
    issue: Column
    fatal: bool = False


def _typed(f: FieldSpec, raw: Column, fixed: bool) -> tuple[Column, Column]:
    """(conversion succeeded, canonical text)."""
    yes = F.lit(True)
    if f.type == "INTEGER":
        n = raw.try_cast("int")
        return n.isNotNull(), n.cast("string")
    if f.type == "LONG":
        n = raw.try_cast("bigint")
        return n.isNotNull(), n.cast("string")
    if f.type == "AMOUNT" and fixed:
        scale = 2 if f.scale is None else f.scale
        n = raw.try_cast("bigint")
        amount = n.cast("decimal(20,0)") / F.lit(10**scale).cast("decimal(20,0)")
        shown = amount.cast(f"decimal(38,{scale})").cast("string")
        return n.isNotNull(), shown
    if f.type in ("DECIMAL", "AMOUNT"):
        return text.is_canonical(raw) | text.is_number(raw), text.decimal_text(raw)
    if f.type == "BOOLEAN":
        hit = raw.isin(*TRUE_FIXED) if fixed else F.lower(raw).isin(*TRUE_DELIMITED)
        return yes, hit.cast("string")
    return yes, raw


def _conversion_message(f: FieldSpec, raw: str, fixed: bool) -> str:
    shown = literal(masking.MASK) if f.sensitive else raw
    head, tail = CONVERSION_FIXED if fixed else CONVERSION_DELIMITED
    return f"concat({literal(head.format(name=f.name))}, {shown}, {literal(tail.format(type=f.type))})"


def coerce(f: FieldSpec, column: str, absent: Column | bool, fixed: bool = False) -> Coerced:
    """``column`` names the trimmed raw text; ``absent`` marks a column or position the record lacks."""
    raw = F.col(column)
    none = F.lit(None).cast("string")
    gone = absent if isinstance(absent, Column) else F.lit(absent)
    blank = F.coalesce(raw == "", F.lit(True))
    ok, canonical = _typed(f, raw, fixed)
    value = F.when(gone, none).when(blank, F.lit(f.default_value).cast("string")).when(ok, canonical).otherwise(raw)
    if fixed:
        absent_text = SHORT_LINE.format(name=f.name, position=f.start_position)
        blank_text = REQUIRED_FIXED.format(name=f.name)
    else:
        absent_text = MISSING_COLUMN.format(column=f.column_name or f.name)
        blank_text = REQUIRED_DELIMITED.format(name=f.name)
    issues = {GONE: issue(f.name, literal(absent_text), "ERROR")} if f.required else {}
    code = F.when(gone, GONE if f.required else 0)
    if f.required and not f.nullable:
        said = literal(blank_text)
        issues[BLANK] = issue(f.name, said, "ERROR", literal(None) if fixed else "''")
        issues[NULL] = issue(f.name, said, "ERROR", literal(None))
        code = code.when(raw.isNull(), NULL).when(blank, BLANK)
    else:
        code = code.when(blank, 0)
    if f.type in CHECKED:
        # a value that does not convert stays as it is, so the record has the raw text
        name = ticked(fcol(f.name))
        issues[UNREADABLE] = issue(f.name, _conversion_message(f, name, fixed), "ERROR", literal(None) if f.sensitive else name)
        code = code.when(~ok, UNREADABLE)
    return Coerced(value, code.otherwise(0), issues)


def coerce_xml(f: FieldSpec, column: str) -> Coerced:
    """XML keeps every value as text; only presence is checked."""
    raw = F.col(column)
    present = F.when(~text.is_blank(raw), raw)
    message = REQUIRED_XML.format(name=f.name, path="null" if f.path is None else f.path)
    value = F.coalesce(present, F.lit(f.default_value))
    if not f.required:
        return Coerced(value, F.lit(0), {})
    return Coerced(value, F.when(present.isNull(), GONE).otherwise(0), {GONE: issue(f.name, literal(message), "ERROR")})


def spark_type(f: FieldSpec) -> str:
    """Type of the optional typed view of a field."""
    scale = f.scale if f.scale is not None else (2 if f.type == "AMOUNT" else 18)
    return {
        "INTEGER": "int",
        "LONG": "bigint",
        "DECIMAL": f"decimal(38,{scale})",
        "AMOUNT": f"decimal(38,{scale})",
        "BOOLEAN": "boolean",
        "DATE": "date",
        "DATETIME": "timestamp",
    }.get(f.type, "string")


def typed(f: FieldSpec, value: Column) -> Column:
    if f.type == "DATE":
        return F.try_to_date(value, f.format or "yyyy-MM-dd")
    if f.type == "DATETIME":
        return F.try_to_timestamp(value, F.lit(f.format)) if f.format else F.try_to_timestamp(value)
    kind = spark_type(f)
    return value if kind == "string" else value.try_cast(kind)

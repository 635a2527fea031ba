"""Field mapping from event fields to output fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import text
from specflow.operators.records import (
    FLAGS, ISSUES, collected, fcol, flags, found, issue, literal, no_issues, quoted, start_columns, ticked, value_of,
)
from specflow.spec import FieldMapping, FieldSpec, FileSpec, SpecError

Transform = Callable[[Column, str | None], Column]


def _decimals(c: Column, arg: str | None) -> Column:
    return c.try_cast("decimal(38,2)").cast("string")


# One entry per transform name; an argument may follow a colon, as in PAD_LEFT:10.
TRANSFORMS: dict[str, Transform] = {
    "UPPERCASE": lambda c, a: F.upper(c),
    "LOWERCASE": lambda c, a: F.lower(c),
    "TRIM": lambda c, a: text.trim(c),
    "PAD_LEFT": lambda c, a: text.pad_left(c, int(a or 10)),
    "PAD_RIGHT": lambda c, a: text.pad_right(c, int(a or 10)),
    "FORMAT_DATE": lambda c, a: F.date_format(F.try_to_date(c, "yyyy-MM-dd"), a or "yyMMdd"),
    "FORMAT_DECIMAL_2DP": _decimals,
}


# Transforms that some texts do not fit; those texts stay and are reported.
PARSING = {"FORMAT_DATE": "date", "FORMAT_DECIMAL_2DP": "number"}


def register_transform(name: str, build: Transform) -> None:
    TRANSFORMS[name] = build


def mapped(m: FieldMapping, source: Column) -> Column:
    """Default for null first, then the named transform or Spark SQL expression (over ``value``)."""
    value = F.coalesce(source, F.lit(m.default_value)) if m.default_value is not None else source
    if m.transform:
        name, _, arg = m.transform.partition(":")
        if name not in TRANSFORMS:
            raise SpecError(f"unknown transform {m.transform}")
        value = TRANSFORMS[name](value, arg or None)
    return value


def unfit(m: FieldMapping, source: Column) -> Column | None:
    """True where the mapping's transform cannot read the text; None for transforms that take any."""
    if not m.transform or m.transform.partition(":")[0] not in PARSING:
        return None
    given = F.coalesce(source, F.lit(m.default_value)) if m.default_value is not None else source
    return given.isNotNull() & ~text.is_blank(given) & mapped(m, source).isNull()


def map_fields(records: DataFrame, mappings: tuple[FieldMapping, ...], order: tuple[str, ...] = (),
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Fresh records that hold only the target fields, in the given order."""
    have = set(records.columns)
    made, errors, wrong = {}, [], F.lit(False)
    for m in mappings:
        source = value_of(m.source_field) if fcol(m.source_field) in have else F.lit(None).cast("string")
        made[m.target_field] = mapped(m, source)
        bad = unfit(m, source)
        if bad is not None:
            kind = PARSING[m.transform.partition(":")[0]]
            made[m.target_field] = F.when(bad, source).otherwise(made[m.target_field])
            raw = f"cast({ticked(fcol(m.source_field))} as string)" if fcol(m.source_field) in have else literal(None)
            wrong = wrong | bad
            errors.append(found(bad, issue(m.target_field, literal(f"'{m.source_field}' is no {kind}"), "ERROR", raw)))
    names = [n for n in order if n in made] + [n for n in made if n not in order]
    frame = records.select(
        "_file", "_seq", F.lit(None).cast("string").alias("_raw"),
        *[made[n].cast("string").alias(fcol(n)) for n in names],
        (collected(errors, ISSUES) if errors else no_issues()).alias("_errors"), *start_columns(), "_metadata", flags(wrong).alias(FLAGS),
        *[quoted(k) for k in keep],
    )
    # expressions see the mapped value under the name ``value``
    for m in mappings:
        if m.transformation:
            target = fcol(m.target_field)
            rest = [quoted(c) for c in frame.columns]
            opened = frame.select(*rest, quoted(target).alias("value"))
            frame = opened.withColumn(target, F.expr(m.transformation).cast("string")).drop("value")
    return frame


def outbound_spec(spec: FileSpec) -> FileSpec:
    """The outbound section as a spec the correction and validation steps accept."""
    config = spec.outbound
    if config is None:
        raise SpecError(f"spec '{spec.name}' has no outbound section")
    targets = [m.target_field for m in config.field_mappings]
    return FileSpec(
        id=spec.id, name=spec.name, format=config.format,
        fields=tuple(FieldSpec(name=t, required=False, nullable=True) for t in targets),
        correction_rules=config.correction_rules, validation_rules=config.validation_rules,
        metadata=spec.metadata,
    )

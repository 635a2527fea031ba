"""Validation rules and field constraints compiled to one issue array."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import checks, masking, text
from specflow.operators.records import (
    FLAGS, ISSUES, collected, fcol, flags, flags_of_issues, issue, literal, pinned, quoted, ticked, value_of,
)
from specflow.spec import FieldSpec, FileSpec, SpecError, ValidationRule

Rule = Callable[[Column, ValidationRule], Column]
_registry: dict[str, Rule] = {}


def register_rule(name: str, build: Rule) -> None:
    """``build`` returns the boolean column that is true when the rule is violated."""
    _registry[name] = build


def _int(value: str | None, fallback: int | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return fallback


def _is_bound(value: str | None) -> bool:
    try:
        float(value)
    except (TypeError, ValueError):
        return False
    return value == value.strip()


def _max_length(c: Column, r: ValidationRule) -> Column:
    limit = _int(r.value, None)
    return F.lit(False) if limit is None else F.length(c) > limit


def _number(op: str) -> Rule:
    return lambda c, r: text.compare_number(c, op, r.value) if _is_bound(r.value) else F.lit(False)


def _between(c: Column, r: ValidationRule) -> Column:
    if not (_is_bound(r.value) and _is_bound(r.secondary_value)):
        return F.lit(False)
    return text.compare_number(c, "<", r.value) | text.compare_number(c, ">", r.secondary_value)


def _allowed(c: Column, r: ValidationRule) -> Column:
    if r.value is None:
        return F.lit(False)
    return ~c.isin(*[v.strip() for v in r.value.split(",")])


def _expression(c: Column, r: ValidationRule) -> Column:
    """The value is a Spark SQL condition that must hold; fields are f_<name>."""
    return ~F.expr(r.value) if r.value else F.lit(False)


_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
}


def _cross_field(c: Column, r: ValidationRule) -> Column:
    """``<operator> <other field>`` must hold; numbers compare as numbers."""
    op, _, other = (r.value or "").strip().partition(" ")
    if op not in _COMPARE or not other:
        return F.lit(False)
    rival = value_of(other.strip())
    both = text.is_number(c) & text.is_number(rival)
    as_numbers = _COMPARE[op](c.try_cast("decimal(38,10)"), rival.try_cast("decimal(38,10)"))
    return ~F.when(both, as_numbers).otherwise(_COMPARE[op](c, rival))


def _date_range(c: Column, r: ValidationRule) -> Column:
    day = F.try_to_date(c, "yyyy-MM-dd")
    low = day < F.lit(r.value).cast("date") if r.value else F.lit(False)
    high = day > F.lit(r.secondary_value).cast("date") if r.secondary_value else F.lit(False)
    return low | high


for _name, _fn in {
    "NOT_NULL": lambda c, r: c.isNull(),
    "NOT_EMPTY": lambda c, r: text.is_blank(c),
    "MIN_LENGTH": lambda c, r: F.length(c) < _int(r.value, 0),
    "MAX_LENGTH": _max_length,
    "EXACT_LENGTH": lambda c, r: F.length(c) != _int(r.value, -1),
    "REGEX": lambda c, r: ~text.full_match(c, r.value if r.value is not None else ".*"),
    "MIN_VALUE": _number("<"),
    "MAX_VALUE": _number(">"),
    "BETWEEN": _between,
    "ALLOWED_VALUES": _allowed,
    "CUSTOM_EXPRESSION": _expression,
    "CROSS_FIELD": _cross_field,
    "DATE_RANGE": _date_range,
    "POSITIVE_NUMBER": lambda c, r: text.compare_number(c, "<=", "0"),
    "ROUTING_CHECKSUM": lambda c, r: ~checks.routing_ok(c),
}.items():
    register_rule(_name, _fn)


def violated(rule: ValidationRule, value: Column) -> Column:
    """Never null: a rule that cannot be decided is not violated."""
    if rule.rule_type not in _registry:
        raise SpecError(f"unknown rule type {rule.rule_type}")
    return F.coalesce(_registry[rule.rule_type](value, rule), F.lit(False))


def check(value: Column, rule_type: str, arg: str | None = None, second: str | None = None) -> Column:
    """One rule as a plain boolean column: true when violated."""
    return violated(ValidationRule("column", "column", rule_type, arg, second), value)


def _rule_issue(rule: ValidationRule, spec: FileSpec) -> Column:
    f = spec.field_spec(rule.field)
    hide = spec.mask_sensitive and f is not None and f.sensitive
    raw = literal(None) if hide else ticked(fcol(rule.field))
    return issue(rule.field, literal(rule.message), rule.severity, raw, rule.rule_id)


def _constraint_issues(f: FieldSpec) -> list[tuple[Column, Column]]:
    """(violated, issue) of each constraint of a field."""
    value, name = value_of(f.name), ticked(fcol(f.name))
    shown = literal(masking.MASK) if f.sensitive else name
    kept = literal(None) if f.sensitive else name
    hits = []

    def add(bad: Column, *message: str, raw: str = literal(None)) -> None:
        hits.append((F.coalesce(bad, F.lit(False)), issue(f.name, f"concat({', '.join(message)})", "ERROR", raw)))

    quoted_value = (literal(f"Field '{f.name}' value '"), shown)
    measured = (literal(f"Field '{f.name}' length "), f"cast(length({name}) as string)")
    if f.validation_regex is not None:
        bad = ~text.full_match(value, f.validation_regex)
        add(bad, *quoted_value, literal("' does not match required pattern"), raw=kept)
    if f.min_length is not None:
        add(F.length(value) < f.min_length, *measured, literal(f" is below minimum {f.min_length}"))
    if f.max_length is not None:
        add(F.length(value) > f.max_length, *measured, literal(f" exceeds maximum {f.max_length}"))
    if f.allowed_values:
        listed = ", ".join(f.allowed_values)
        add(~value.isin(*f.allowed_values), *quoted_value, literal(f"' not in allowed values: [{listed}]"))
    return hits


def apply_validations(records: DataFrame, spec: FileSpec) -> DataFrame:
    """All rules in spec order, then all field constraints; nothing stops at the first hit.

    Every rule is one bit of a record, evaluated once. Flags come from the bits; issues are built from
    them for the rows and by the plans that read them.
    """
    soft = [r for r in spec.validation_rules if r.severity in ("INFO", "WARNING")]
    hard = [r for r in spec.validation_rules if r.severity not in ("INFO", "WARNING")]
    hits = [(violated(r, value_of(r.field)), _rule_issue(r, spec), r.severity) for r in hard]
    hits += [(bad, told, "ERROR") for f in spec.fields for bad, told in _constraint_issues(f)]
    n_errors = len(hits)
    hits += [(violated(r, value_of(r.field)), _rule_issue(r, spec), r.severity) for r in soft]
    if not hits:
        return records
    names = [f"_hit{k}" for k in range(len(hits))]
    known = F.col(FLAGS) if FLAGS in records.columns else flags_of_issues()
    once = pinned(records.select("*", known.alias("_known"), *[bad.alias(n) for (bad, _, _), n in zip(hits, names)]), names)

    def any_of(some: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.col(n) for n in some], F.lit(False))

    fatal = [n for n, (_, _, severity) in zip(names, hits) if severity == "FATAL"]
    now = flags(any_of(names[:n_errors]), any_of(fatal), any_of(names[n_errors:]))
    nothing = F.expr(f"cast(array() as {ISSUES})")
    issues = [F.when(F.col(n), told).otherwise(nothing) for n, (_, told, _) in zip(names, hits)]
    made = {
        "_errors": F.concat("_errors", collected(issues[:n_errors], ISSUES)) if n_errors else F.col("_errors"),
        "_warnings": F.concat("_warnings", collected(issues[n_errors:], ISSUES)) if n_errors < len(hits) else F.col("_warnings"),
    }
    columns = [made[c].alias(c) if c in made else quoted(c) for c in records.columns if c != FLAGS]
    return once.select(*columns, F.col("_known").bitwiseOR(now).alias(FLAGS))

"""Correction rules compiled to one projection per step."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import dates, text
from specflow.operators.records import CHANGES, collected, fcol, literal, pinned, quoted, ticked
from specflow.spec import CorrectionRule, FieldSpec, FileSpec, SpecError

Correction = Callable[[Column, CorrectionRule, FieldSpec | None], Column]
_registry: dict[str, Correction] = {}


def register_correction(name: str, build: Correction) -> None:
    """Make ``name`` usable as a correction type in specs."""
    _registry[name] = build


def _simple(fn: Callable[[Column], Column]) -> Correction:
    return lambda c, rule, f: fn(c)


def _width(rule: CorrectionRule) -> int | None:
    try:
        return int(rule.value)
    except (TypeError, ValueError):
        return None


def _pad(fn, char: str) -> Correction:
    def build(c, rule, f):
        width = _width(rule)
        return c if width is None else fn(c, width, rule.pad_char or char)

    return build


def _regex_replace(c: Column, rule: CorrectionRule, f) -> Column:
    parts = (rule.value or "").split("->")
    if len(parts) != 2:
        return c
    return F.regexp_replace(c, parts[0].strip(), parts[1].strip())


for _name, _fn in {
    "TRIM": text.trim,
    "TRIM_LEADING": text.trim_leading,
    "TRIM_TRAILING": text.trim_trailing,
    "UPPERCASE": F.upper,
    "LOWERCASE": F.lower,
    "TITLE_CASE": F.initcap,
    "NUMBER_FORMAT_COERCE": lambda c: F.regexp_replace(c, r"[$,€£¥\s]", ""),
    "REMOVE_SPECIAL_CHARS": lambda c: F.regexp_replace(c, r"[^a-zA-Z0-9 ]", ""),
}.items():
    register_correction(_name, _simple(_fn))

register_correction(
    "DATE_FORMAT_COERCE", lambda c, rule, f: dates.coerce_date(c, rule.value or (f.format if f else None))
)
register_correction("DEFAULT_IF_NULL", lambda c, rule, f: F.coalesce(c, F.lit(rule.value)))
register_correction(
    "DEFAULT_IF_EMPTY", lambda c, rule, f: F.when(text.is_blank(c), F.lit(rule.value)).otherwise(c)
)
register_correction("PAD_LEFT", _pad(text.pad_left, "0"))
register_correction("PAD_RIGHT", _pad(text.pad_right, " "))
register_correction("REGEX_REPLACE", _regex_replace)


def expression(rule: CorrectionRule, value: Column, f: FieldSpec | None = None) -> Column:
    if rule.correction_type not in _registry:
        raise SpecError(f"unknown correction type {rule.correction_type}")
    return _registry[rule.correction_type](value, rule, f).cast("string")


def apply_corrections(records: DataFrame, spec: FileSpec) -> DataFrame:
    """Rules run in applyOrder (ties keep spec order); every change is logged.

    The k-th rule of each field shares one projection, so plan size grows with
    the number of rules and never with their nesting.
    """
    rules = sorted(spec.correction_rules, key=lambda r: r.apply_order)
    if not rules:
        return records
    latest = {name: fcol(name) for name in spec.record_fields}
    depth: dict[str, int] = defaultdict(int)
    layers: dict[int, list[Column]] = defaultdict(list)
    changes, differ = [], F.lit(False)
    for number, rule in enumerate(rules):
        before, after = latest[rule.field], f"_step{number}"
        built = expression(rule, quoted(before), spec.field_spec(rule.field))
        layers[depth[rule.field]].append(built.alias(after))
        # the log is read from finished steps, where a field's first value has a name of its own
        first = depth[rule.field] == 0
        old, new = ticked(f"_first_{before}" if first else before), ticked(after)
        changes.append(
            F.expr(
                f"case when not ({old} <=> {new}) then array(named_struct('field', {literal(rule.field)}, "
                f"'original', {old}, 'corrected', {new}, 'type', {literal(rule.correction_type)})) "
                f"else cast(array() as {CHANGES}) end"
            )
        )
        differ = differ | ~quoted(before).eqNullSafe(quoted(after))
        depth[rule.field] += 1
        latest[rule.field] = after
    columns = records.columns
    for level in sorted(layers):
        records = records.select("*", *layers[level])
    touched = {fcol(name): last for name, last in latest.items() if last != fcol(name)}
    steps = [f"_step{n}" for n in range(len(rules))]
    firsts = {f"_first_{name}": name for name in touched}
    done = records.select(
        *[quoted(c) for c in columns if c not in touched and c != "_corrected"],
        *[quoted(name).alias(alias) for alias, name in firsts.items()], *steps,
        *[quoted(last).alias(name) for name, last in touched.items()],
        (F.col("_corrected") | differ).alias("_corrected"),
    )
    once = pinned(done, [*firsts, *steps, *touched, "_corrected"])
    # whoever reads the log has it built; others need the steps only
    log = F.concat("_corrections", collected(changes, CHANGES))
    return once.select(*[log.alias(c) if c == "_corrections" else quoted(c) for c in columns])


def correct_column(value: Column, correction_type: str, arg: str | None = None, pad_char: str | None = None) -> Column:
    """One correction as a plain column expression."""
    rule = CorrectionRule("column", "column", correction_type, arg, 0, pad_char)
    return expression(rule, value)


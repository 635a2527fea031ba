"""The declarative file spec: model, JSON loading, aliases and definition checks."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

# The names a spec file may use.
FORMATS = ("CSV", "FIXED_WIDTH", "XML", "JSON", "NACHA", "ISO20022", "SWIFT_MT", "EDI_X12", "DELIMITED", "CUSTOM")
TYPES = (
    "STRING", "INTEGER", "LONG", "DECIMAL", "AMOUNT", "DATE", "DATETIME", "BOOLEAN",
    "ALPHANUMERIC", "ROUTING_NUMBER", "ACCOUNT_NUMBER", "ABA", "ENUM",
)
SEVERITIES = ("INFO", "WARNING", "ERROR", "FATAL")

# Alternative rule names found in spec documents.
RULE_ALIASES = {"REQUIRED": "NOT_EMPTY", "RANGE": "BETWEEN"}
CORRECTION_ALIASES = {"UPPER_CASE": "UPPERCASE", "LOWER_CASE": "LOWERCASE", "COERCE_DATE": "DATE_FORMAT_COERCE"}


class SpecError(ValueError):
    """The spec cannot be compiled."""


class UnsupportedFormatError(SpecError):
    """No reader or generator is registered for the format."""


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "STRING"
    start_position: int | None = None
    length: int | None = None
    column_index: int | None = None
    column_name: str | None = None
    path: str | None = None
    xml_attribute: str | None = None
    required: bool = True
    nullable: bool = False
    default_value: str | None = None
    format: str | None = None
    scale: int | None = None
    validation_regex: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    allowed_values: tuple[str, ...] = ()
    sensitive: bool = False
    display_name: str | None = None
    description: str = ""


@dataclass(frozen=True)
class ValidationRule:
    rule_id: str
    field: str
    rule_type: str
    value: str | None = None
    secondary_value: str | None = None
    message: str = ""
    severity: str = "ERROR"


@dataclass(frozen=True)
class CorrectionRule:
    rule_id: str
    field: str
    correction_type: str
    value: str | None = None
    apply_order: int = 0
    pad_char: str | None = None


@dataclass(frozen=True)
class FieldMapping:
    source_field: str
    target_field: str
    transform: str | None = None
    transformation: str | None = None
    default_value: str | None = None


@dataclass(frozen=True)
class OutputSpec:
    format: str
    delimiter: str | None = None
    encoding: str = "UTF-8"
    has_header: bool = False
    field_mappings: tuple[FieldMapping, ...] = ()


@dataclass(frozen=True)
class OutboundConfig:
    format: str
    field_mappings: tuple[FieldMapping, ...] = ()
    field_order: tuple[str, ...] = ()
    correction_rules: tuple[CorrectionRule, ...] = ()
    validation_rules: tuple[ValidationRule, ...] = ()
    header_template: str | None = None
    footer_template: str | None = None
    aggregation_key: str | None = None
    encoding: str = "UTF-8"
    file_naming_pattern: str = "output_{specId}_{timestamp}.{ext}"
    delimiter: str | None = None


@dataclass(frozen=True)
class FileSpec:
    id: str
    name: str
    format: str
    fields: tuple[FieldSpec, ...] = ()
    description: str = ""
    version: str = "1.0"
    encoding: str = "UTF-8"
    has_header: bool = False
    delimiter: str | None = None
    record_separator: str = "\n"
    skip_lines_count: int = 0
    validation_rules: tuple[ValidationRule, ...] = ()
    correction_rules: tuple[CorrectionRule, ...] = ()
    output_spec: OutputSpec | None = None
    outbound: OutboundConfig | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)
    position_base: int = 0
    mask_sensitive: bool = False
    recoerce_after_correction: bool = False

    @property
    def record_fields(self) -> list[str]:
        """Declared fields, then fields that only a rule names."""
        names = [f.name for f in self.fields]
        for rule in (*self.correction_rules, *self.validation_rules):
            if rule.field not in names:
                names.append(rule.field)
        return names

    def field_spec(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)


def _snake(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", key).lower()


def _build(cls, raw: Mapping[str, Any], **extra):
    known = {f.name for f in fields(cls)}
    values = {}
    for key, value in raw.items():
        name = _snake(key)
        if name not in known:
            if not key.startswith(("created", "updated")):
                warnings.warn(f"{cls.__name__}: unknown key '{key}' ignored", stacklevel=3)
            continue
        if value is None:
            continue
        values[name] = tuple(value) if isinstance(value, list) else value
    values.update(extra)
    return cls(**values)


def _expand(rule: Mapping[str, Any], names: list[str]) -> list[dict]:
    """One rule per target: ``field``, ``fields`` or the ``*`` wildcard."""
    targets = rule.get("fields", [rule.get("field")])
    if "*" in targets:
        targets = names
    body = {k: v for k, v in rule.items() if k != "fields"}
    return [{**body, "field": t} for t in targets]


def _correction(raw: Mapping[str, Any], position: int) -> CorrectionRule:
    body = dict(raw)
    kind = body.pop("correctionType", None) or body.pop("type")
    value = body.pop("value", None)
    if value is None:
        value = body.pop("length", None)
    body.pop("length", None)
    return _build(
        CorrectionRule,
        {"ruleId": f"correction-{position}", "applyOrder": position, **body},
        correction_type=CORRECTION_ALIASES.get(kind, kind),
        value=None if value is None else str(value),
    )


def _validation(raw: Mapping[str, Any], position: int) -> ValidationRule:
    body = dict(raw)
    kind = body.pop("ruleType", None) or body.pop("type")
    low, high = body.pop("min", None), body.pop("max", None)
    value = body.pop("value", body.pop("values", low))
    second = body.pop("secondaryValue", high)
    if isinstance(value, list):
        value = ",".join(map(str, value))
    kind = RULE_ALIASES.get(kind, kind)
    return _build(
        ValidationRule,
        {"ruleId": f"rule-{position}", "message": f"{kind} failed for {body.get('field')}", **body},
        rule_type=kind,
        value=None if value is None else str(value),
        secondary_value=None if second is None else str(second),
    )


def corrections_from(raw: list[Mapping[str, Any]], names: list[str]) -> tuple[CorrectionRule, ...]:
    return tuple(_correction(r, i) for i, rule in enumerate(raw) for r in _expand(rule, names))


def validations_from(raw: list[Mapping[str, Any]], names: list[str]) -> tuple[ValidationRule, ...]:
    return tuple(_validation(r, i) for i, rule in enumerate(raw) for r in _expand(rule, names))


# Short field keys of the compact spec dialect.
FIELD_ALIASES = {"index": "columnIndex", "masked": "sensitive"}


def _field(raw: Mapping[str, Any]) -> FieldSpec:
    body = {FIELD_ALIASES.get(k, k): v for k, v in raw.items() if k != "validations"}
    return _build(FieldSpec, body)


def _inline_rules(raw_fields: list[Mapping[str, Any]]) -> list[dict]:
    return [{**rule, "field": f["name"]} for f in raw_fields for rule in f.get("validations", [])]


def load_spec(source: str | Mapping[str, Any]) -> FileSpec:
    """Build a spec from a JSON document or an already parsed mapping."""
    raw = dict(json.loads(source) if isinstance(source, str) else source)
    raw_fields = raw.pop("fields", [])
    names = [f["name"] for f in raw_fields]
    corrections = corrections_from(raw.pop("correctionRules", []), names)
    validations = validations_from(raw.pop("validationRules", []) + _inline_rules(raw_fields), names)
    output = raw.pop("outputSpec", None)
    outbound = raw.pop("outbound", None)
    raw.setdefault("id", raw.get("name", "spec"))
    raw.setdefault("name", raw["id"])
    return _build(
        FileSpec,
        raw,
        fields=tuple(_field(f) for f in raw_fields),
        correction_rules=corrections,
        validation_rules=validations,
        output_spec=_output(output),
        outbound=_outbound(outbound),
    )


def _mappings(raw: Mapping[str, Any]) -> tuple[FieldMapping, ...]:
    return tuple(_build(FieldMapping, m) for m in raw.get("fieldMappings", []))


def _output(raw) -> OutputSpec | None:
    return None if raw is None else _build(OutputSpec, raw, field_mappings=_mappings(raw))


def _outbound(raw) -> OutboundConfig | None:
    if raw is None:
        return None
    mappings = _mappings(raw)
    targets = [m.target_field for m in mappings]
    return _build(
        OutboundConfig,
        raw,
        field_mappings=mappings,
        correction_rules=corrections_from(raw.get("correctionRules", []), targets),
        validation_rules=validations_from(raw.get("validationRules", []), targets),
    )


def issues(spec: FileSpec) -> list[str]:
    """Definition problems, in field order; empty when the spec can be compiled."""
    found = []
    if spec.format not in FORMATS:
        found.append(f"unknown format {spec.format}")
    if not spec.fields:
        found.append("spec has no fields")
    if spec.format in ("XML", "ISO20022") and "recordXPath" not in spec.metadata:
        found.append("metadata key recordXPath is missing")
    if spec.format == "EDI_X12" and "recordSegment" not in spec.metadata:
        found.append("metadata key recordSegment is missing")
    for f in spec.fields:
        if f.type not in TYPES:
            found.append(f"{f.name}: unknown type {f.type}")
        if spec.format in ("CSV", "DELIMITED") and f.column_index is None and f.column_name is None:
            found.append(f"{f.name}: needs columnIndex or columnName")
        if spec.format == "FIXED_WIDTH":
            if f.start_position is None:
                found.append(f"{f.name}: needs startPosition")
            if not f.length or f.length <= 0:
                found.append(f"{f.name}: needs a positive length")
        if spec.format in ("XML", "ISO20022") and f.path is None and f.xml_attribute is None:
            found.append(f"{f.name}: needs path or xmlAttribute")
    return found


def require_valid(spec: FileSpec) -> FileSpec:
    found = issues(spec)
    if found:
        raise SpecError("; ".join(found))
    return spec


def inbound(specs: list[FileSpec]) -> list[FileSpec]:
    return [s for s in specs if s.fields]


def outbound(specs: list[FileSpec]) -> list[FileSpec]:
    return [s for s in specs if s.outbound is not None]


def with_rules(spec: FileSpec, corrections=(), validations=()) -> FileSpec:
    return replace(spec, correction_rules=tuple(corrections), validation_rules=tuple(validations))

import pytest
from pyspark.sql import functions as F

from specflow.operators import route
from specflow.operators.correct import apply_corrections, correct_column, register_correction
from specflow.operators.validate import apply_validations, check, register_rule
from specflow.plans.inbound import check_patterns, processed
from specflow.sources.delimited import parse_delimited
from specflow.spec import CorrectionRule, FieldSpec, FileSpec, SpecError, ValidationRule, load_spec


def corrected(spark, kind, arg, value):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(correct_column(F.col("v"), kind, arg).alias("o")).first().o


@pytest.mark.parametrize("kind, arg, value, expected", [
    ("TRIM", None, "\u2003fog \n", "fog"), ("TRIM_LEADING", None, "\t\tmist ", "mist "), ("TRIM_TRAILING", None, " dew\u00a0", " dew"),
    ("UPPERCASE", None, "straße", "STRASSE"), ("LOWERCASE", None, "ÄRGER-9", "ärger-9"),
    ("TITLE_CASE", None, "grey heron, YOUNG", "Grey Heron, Young"), ("TITLE_CASE", None, "d'ARC le-fay", "D'arc Le-fay"),
    ("REMOVE_SPECIAL_CHARS", None, "no. 7/b (new)", "no 7b new"),
    ("DEFAULT_IF_NULL", "dusk", None, "dusk"), ("DEFAULT_IF_NULL", "dusk", "", ""),
    ("DEFAULT_IF_EMPTY", "dawn", "\u3000", "dawn"), ("DEFAULT_IF_EMPTY", "dawn", None, "dawn"), ("DEFAULT_IF_EMPTY", "dawn", "noon", "noon"),
    ("PAD_LEFT", "5", "71", "00071"), ("PAD_LEFT", "3", "7100", "7100"), ("PAD_LEFT", "wide", "7", "7"),
    ("PAD_RIGHT", "4", "ox", "ox  "), ("PAD_RIGHT", "1", "ox", "ox"),
    ("DATE_FORMAT_COERCE", "yyyy-MM-dd", "07/04/1999", "1999-07-04"), ("DATE_FORMAT_COERCE", "yyyy-MM-dd", "19990704", "1999-07-04"),
    ("DATE_FORMAT_COERCE", "yyyy-MM-dd", "27/08/1999", "1999-08-27"), ("DATE_FORMAT_COERCE", "ddMMyy", "08-27-1999", "270899"),
    ("DATE_FORMAT_COERCE", None, "1999/08/27", "1999-08-27"), ("DATE_FORMAT_COERCE", None, "08271999", "1999-08-27"),
    ("DATE_FORMAT_COERCE", "yyyy-MM-dd", "some day", "some day"),
    ("DATE_FORMAT_COERCE", None, "2024-02-30", "2024-02-29"), ("DATE_FORMAT_COERCE", None, "31/04/2023", "2023-04-30"), ("DATE_FORMAT_COERCE", None, "02/31/2023", "2023-02-28"),
    ("DATE_FORMAT_COERCE", None, "2023-13-01", "2023-13-01"), ("DATE_FORMAT_COERCE", None, "2023-01-32", "2023-01-32"), ("DATE_FORMAT_COERCE", None, "20230100", "20230100"), ("DATE_FORMAT_COERCE", None, "1999-8-7", "1999-8-7"),
    ("NUMBER_FORMAT_COERCE", None, "£9,000,001.5", "9000001.5"), ("NUMBER_FORMAT_COERCE", None, "¥ 80", "80"),
    ("REGEX_REPLACE", "[aeiou]+ -> _", "queue up", "q_ _p"), ("REGEX_REPLACE", r"(\w+)@(\w+) -> $2.$1", "a@b", "b.a"),
    ("REGEX_REPLACE", "without arrow", "y", "y"), ("UPPERCASE", None, None, None),
])
def test_corrections(spark, kind, arg, value, expected):
    assert corrected(spark, kind, arg, value) == expected


def test_order_and_log(spark, records):
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("v"),), correction_rules=(
        CorrectionRule("b", "v", "UPPERCASE", None, 2), CorrectionRule("a", "v", "TRIM", None, 1)))
    row = apply_corrections(records(spec, {"v": " teal\t"}), spec).first()
    assert row.f_v == "TEAL" and row._corrected
    assert [(c.type, c.original, c.corrected) for c in row._corrections] == [("TRIM", " teal\t", "teal"), ("UPPERCASE", "teal", "TEAL")]


def test_no_change_no_log(spark, records):
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("v"),), correction_rules=(CorrectionRule("a", "v", "TRIM"),))
    row = apply_corrections(records(spec, {"v": "x"}, {"v": None}), spec).collect()
    assert not any(r._corrected or r._corrections for r in row)


def test_default_for_a_field_the_spec_lacks(spark, records):
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("v"),), correction_rules=(CorrectionRule("a", "extra", "DEFAULT_IF_NULL", "E"),))
    row = apply_corrections(records(spec, {"v": "x"}), spec).first()
    assert row.f_extra == "E" and row._corrections[0].original is None


def test_many_rules_stay_flat(spark, records):
    rules = tuple(CorrectionRule(f"r{i}", "v", "REGEX_REPLACE", f"{i % 10} -> x", i) for i in range(40))
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("v"),), correction_rules=rules)
    assert apply_corrections(records(spec, {"v": "0123456789"}), spec).first().f_v == "x" * 10


def test_unknown_types_fail_at_compile_time(spark, records):
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("v"),), correction_rules=(CorrectionRule("a", "v", "NOPE"),))
    with pytest.raises(SpecError):
        apply_corrections(records(spec, {"v": "x"}), spec)
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("v"),), validation_rules=(ValidationRule("a", "v", "NOPE"),))
    with pytest.raises(SpecError):
        apply_validations(records(spec, {"v": "x"}), spec)
    with pytest.raises(Exception):
        check_patterns(spark, FileSpec("s", "s", "CUSTOM", (FieldSpec("v", validation_regex="(["),)))


@pytest.mark.parametrize("kind, arg, second, value, hit", [
    ("NOT_NULL", None, None, None, True), ("NOT_NULL", None, None, "", False),
    ("NOT_EMPTY", None, None, " \t", True), ("NOT_EMPTY", None, None, "x", False),
    ("MIN_LENGTH", "3", None, "ab", True), ("MIN_LENGTH", "3", None, None, False), ("MIN_LENGTH", "x", None, "", False),
    ("MAX_LENGTH", "3", None, "abcd", True), ("MAX_LENGTH", "x", None, "abcd", False),
    ("EXACT_LENGTH", "3", None, "abc", False), ("EXACT_LENGTH", "x", None, "abc", True), ("EXACT_LENGTH", "x", None, None, False),
    ("REGEX", "^[0-9]{9}$", None, "021000021", False), ("REGEX", "^[0-9]{9}$", None, "02100002X", True), ("REGEX", "[0-9]{9}", None, "12345", True),
    ("REGEX", "a|b", None, "ab", True), ("REGEX", None, None, "anything", False), ("REGEX", "[0-9]+", None, "1\n", True),
    ("MIN_VALUE", "0", None, "500", False), ("MIN_VALUE", "0", None, "0", False), ("MIN_VALUE", "0", None, "-1", True),
    ("MIN_VALUE", "0", None, "abc", False), ("MIN_VALUE", "0", None, None, False), ("MIN_VALUE", "bad", None, "-5", False),
    ("MAX_VALUE", "10", None, "10.0001", True), ("MAX_VALUE", "10", None, "1e2", True), ("MAX_VALUE", "5", None, "9" * 45, True),
    ("BETWEEN", "1", "5", "0.5", True), ("BETWEEN", "1", "5", "5", False), ("BETWEEN", "1", None, "50", False),
    ("ALLOWED_VALUES", "ACTIVE, INACTIVE", None, "INACTIVE", False), ("ALLOWED_VALUES", "ACTIVE,INACTIVE", None, "UNKNOWN", True),
    ("ALLOWED_VALUES", None, None, "x", False), ("ALLOWED_VALUES", "A", None, None, False),
    ("DATE_RANGE", "2024-01-01", "2024-12-31", "2025-01-01", True), ("DATE_RANGE", "2024-01-01", None, "2024-06-01", False),
    ("POSITIVE_NUMBER", None, None, "0", True), ("POSITIVE_NUMBER", None, None, "0.01", False),
    ("ROUTING_CHECKSUM", None, None, "021000021", False), ("ROUTING_CHECKSUM", None, None, "021000022", True), ("ROUTING_CHECKSUM", None, None, "12345", True),
    ("CUSTOM_EXPRESSION", None, None, "x", False), ("CROSS_FIELD", None, None, "x", False),
])
def test_rules(spark, kind, arg, second, value, hit):
    frame = spark.createDataFrame([(value,)], "v string")
    assert frame.select(check(F.col("v"), kind, arg, second).alias("o")).first().o is hit


def test_severities_and_field_constraints(spark, records):
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("a", min_length=2, max_length=3, allowed_values=("abc", "x"), validation_regex="[a-z]+", sensitive=True),), validation_rules=(
        ValidationRule("w", "a", "MAX_LENGTH", "4", None, "long", "WARNING"), ValidationRule("i", "a", "MAX_LENGTH", "4", None, "info", "INFO"),
        ValidationRule("e", "a", "NOT_NULL", None, None, "null", "ERROR"), ValidationRule("f", "a", "REGEX", "[a-z]*", None, "odd", "FATAL")))
    long, short, null = apply_validations(records(spec, {"a": "ABCDE"}, {"a": "x"}, {"a": None}), spec).orderBy("_seq").collect()
    assert [w.severity for w in long._warnings] == ["WARNING", "INFO"]
    assert [e.rule_id for e in long._errors] == ["f", None, None, None]
    assert long._errors[0].raw_value == "ABCDE"          # rule hits keep the value
    assert long._errors[1].raw_value is None             # constraint hits mask it
    assert "***" in long._errors[1].message and "ABCDE" not in long._errors[3].message
    assert [e.message for e in short._errors] == ["Field 'a' length 1 is below minimum 2"]
    assert [e.rule_id for e in null._errors] == ["e"]


def test_cross_field_and_expression(spark, records):
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("a"), FieldSpec("b")), validation_rules=(
        ValidationRule("x", "a", "CROSS_FIELD", "<= b", None, "order"), ValidationRule("y", "a", "CUSTOM_EXPRESSION", "length(f_a) < 3", None, "len")))
    rows = apply_validations(records(spec, {"a": "9", "b": "10"}, {"a": "11", "b": "2"}, {"a": "abc", "b": "abd"}), spec).orderBy("_seq").collect()
    assert [[e.rule_id for e in r._errors] for r in rows] == [[], ["x"], ["y"]]


def test_user_rules(spark, records):
    register_correction("REVERSE", lambda c, rule, f: F.reverse(c))
    register_rule("EVEN", lambda c, rule: c.try_cast("int") % 2 != 0)
    spec = FileSpec("s", "s", "CUSTOM", (FieldSpec("a"),), correction_rules=(CorrectionRule("c", "a", "REVERSE"),), validation_rules=(ValidationRule("v", "a", "EVEN"),))
    row = apply_validations(apply_corrections(records(spec, {"a": "21"}), spec), spec).first()
    assert row.f_a == "12" and not row._errors


CARGO = load_spec({"id": "cargo", "format": "DELIMITED", "delimiter": "|", "fields": [
    {"name": "crate", "columnIndex": 0}, {"name": "port", "columnIndex": 1, "sensitive": True},
    {"name": "tons", "type": "DECIMAL", "columnIndex": 2}], "validationRules": [
    {"ruleId": "where", "field": "port", "ruleType": "NOT_EMPTY", "message": "no port", "severity": "FATAL"}]})


def test_run_with_a_fatal_record(lines):
    done = processed(parse_delimited(lines("T1|A1|5", "T2||6", "T3|A3|7"), CARGO), CARGO)
    row = route.with_success_rate(route.with_status(route.summarise(done))).first()
    assert (row.total_records, row.successful_records, row.failed_records, row.status) == (3, 2, 1, "COMPLETED_WITH_ERRORS")
    assert row.success_rate == pytest.approx(2 / 3)
    assert [(e.sequence_number, e.severity) for e in route.error_details(done).collect()] == [(1, "ERROR"), (1, "FATAL")]


def test_invalid_records_pass_uncounted_unless_skipped(lines):
    parsed = parse_delimited(lines("T1|A1|x", "T2|A2|6"), CARGO)
    row = route.summarise(processed(parsed, CARGO)).first()
    assert (row.total_records, row.successful_records, row.failed_records) == (2, 1, 0)
    row = route.summarise(processed(parsed, CARGO, True)).first()
    assert (row.total_records, row.successful_records, row.failed_records) == (2, 1, 1)


@pytest.mark.parametrize("rows, status", [
    (["T1|A1|5"], "COMPLETED"), (["T1||5"], "FAILED"), (["T1||5", "T2|A|5"], "COMPLETED_WITH_ERRORS")])
def test_status(lines, rows, status):
    assert route.with_status(route.summarise(processed(parse_delimited(lines(*rows), CARGO), CARGO))).first().status == status


def test_empty_run(lines, spark):
    none = lines("x").filter("false")
    row = route.with_success_rate(route.with_status(route.summarise(processed(parse_delimited(none, CARGO), CARGO)))).first()
    assert (row.total_records, row.status, row.success_rate) == (0, "COMPLETED", 0.0)


def test_conversion_error_survives_correction_unless_asked(lines):
    raw = {"id": "n", "format": "DELIMITED", "delimiter": "|", "fields": [{"name": "v", "type": "DECIMAL", "columnIndex": 0}],
           "correctionRules": [{"ruleId": "c", "field": "v", "correctionType": "NUMBER_FORMAT_COERCE"}]}
    spec = load_spec(raw)
    row = processed(parse_delimited(lines("€7,250.10"), spec), spec).first()
    assert row.f_v == "7250.10" and len(row._errors) == 1
    spec = load_spec({**raw, "recoerceAfterCorrection": True})
    assert not processed(parse_delimited(lines("€7,250.10"), spec), spec).first()._errors

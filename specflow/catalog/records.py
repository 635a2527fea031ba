"""Coercion, correction, validation and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from specflow.catalog.base import (
    DAY, PRICE, ORDER, ORDER_FIELDS, ORDER_SPEC, ORDER_SQL, columns, register, select_sql, order_lines,
)
from specflow.functions import checks, masking
from specflow.operators import coerce, route
from specflow.operators.correct import apply_corrections
from specflow.operators.records import attach_metadata, from_columns, read_metadata
from specflow.operators.validate import apply_validations, register_rule
from specflow.plans.inbound import dry_run, processed
from specflow.session import table
from specflow.sources.delimited import parse_delimited
from specflow.sources.fixed_width import parse_fixed_width
from specflow.spec import CorrectionRule, FieldSpec, FileSpec, ValidationRule, load_spec


# --- coercion -------------------------------------------------------------------------

def _one_field(spark, sf, name, key, value, f: FieldSpec, fixed=False):
    """Rows of a table as ``key|value`` lines, parsed back through one field."""
    rows = columns(spark, sf, name, {"k": key, "v": value})
    if fixed:
        line = F.concat(F.lit("#"), F.col("v"))
        spec = FileSpec("one", "one", "FIXED_WIDTH", (f,))
    else:
        line = F.concat_ws("|", F.lit("#"), "v")
        spec = FileSpec("one", "one", "DELIMITED", (f,), delimiter="|")
    lines = rows.select(F.lit(None).cast("string").alias("_file"), F.col("k").alias("_seq"), line.alias("_raw"))
    parsed = parse_fixed_width(lines, spec) if fixed else parse_delimited(lines, spec)
    return parsed.select(
        F.col("_seq").alias("k"), F.col("f_v").alias("value"),
        F.get("_errors", F.lit(0)).getField("message").alias("error"),
    ), spec


def _coerce(name, ids, src, key, value, expected, error, f, fixed=False):
    @register(name, ids, f"SELECT k, {expected} AS value, {error} AS error FROM (SELECT {key} AS k, {value} AS v FROM {src})")
    def run(spark, sf):
        return _one_field(spark, sf, src, key, value, f, fixed)[0]


DIRTY_QTY = "CASE WHEN o_orderstatus = 'P' THEN 'n/a' WHEN o_orderstatus = 'F' THEN lpad(CAST(o_custkey AS STRING), 9, '0') ELSE ' +' || CAST(o_custkey AS STRING) || ' ' END"
_coerce(
    "coerce_int", "PRJ-03", "orders", "o_orderkey", DIRTY_QTY,
    "CASE WHEN v = 'n/a' THEN v ELSE CAST(CAST(replace(trim(v), '+', '') AS INT) AS STRING) END",
    "CASE WHEN v = 'n/a' THEN 'Cannot convert ''v'' value ''n/a'' to INTEGER' END",
    FieldSpec("v", "INTEGER", column_index=1),
)
_coerce(
    "coerce_long", "PRJ-04", "lineitem",
    "l_orderkey", "CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS STRING) || '.0' ELSE '5000000000' || CAST(l_partkey AS STRING) END",
    "CASE WHEN v LIKE '%.0' THEN v ELSE CAST(CAST(v AS BIGINT) AS STRING) END",
    "CASE WHEN v LIKE '%.0' THEN 'Cannot convert ''v'' value ''' || v || ''' to LONG' END",
    FieldSpec("v", "LONG", column_index=1),
)
_coerce(
    "coerce_decimal", "PRJ-05", "orders", "o_orderkey", ORDER["price"], "v",
    "CASE WHEN v LIKE '$%' THEN 'Cannot convert ''v'' value ''' || v || ''' to DECIMAL' END",
    FieldSpec("v", "DECIMAL", column_index=1),
)
CENTS = "CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END || lpad(replace(" + PRICE + ", '.', ''), 12, '0')"
_coerce(
    "coerce_amount", "PRJ-06", "orders", "o_orderkey", CENTS,
    "CASE WHEN v LIKE 'x%' THEN v ELSE CAST(CAST(CAST(v AS BIGINT) AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) :: VARCHAR END",
    "CASE WHEN v LIKE 'x%' THEN 'Type conversion failed for ''v'': ''' || v || ''' is not AMOUNT' END",
    FieldSpec("v", "AMOUNT", start_position=1, length=20, scale=2), fixed=True,
)
FLAGS = "CASE event_type WHEN 'click' THEN 'YES' WHEN 'view' THEN 'Y' WHEN 'error' THEN 'true' WHEN 'signup' THEN '1' ELSE 'off' END"
_coerce(
    "coerce_bool_csv", "PRJ-07", "events", "event_id", FLAGS,
    "CASE WHEN lower(v) IN ('true','1','yes','y') THEN 'true' ELSE 'false' END", "CAST(NULL AS VARCHAR)",
    FieldSpec("v", "BOOLEAN", column_index=1),
)
_coerce(
    "coerce_bool_fw", "PRJ-08", "events", "event_id", FLAGS,
    "CASE WHEN v IN ('1','Y','T','true') THEN 'true' ELSE 'false' END", "CAST(NULL AS VARCHAR)",
    FieldSpec("v", "BOOLEAN", start_position=1, length=5), fixed=True,
)


@register("coerce_date", "PRJ-09", f"SELECT k, CASE WHEN v LIKE '%/%' THEN NULL ELSE v END AS day FROM (SELECT o_orderkey AS k, {ORDER['placed']} AS v FROM orders)")
def coerce_date(spark, sf):
    rows = columns(spark, sf, "orders", {"k": "o_orderkey", "v": ORDER["placed"]})
    typed = coerce.typed(FieldSpec("v", "DATE", format="yyyy-MM-dd"), F.col("v"))
    return rows.select("k", typed.cast("string").alias("day"))


PARSE_SQL = f"WITH raw AS ({select_sql('orders', ORDER)}) "


def _parsed(spark, sf):
    return parse_delimited(order_lines(spark, sf), ORDER_SPEC)


@register("coerce_errors", "PRJ-10", PARSE_SQL + """
SELECT k, 'price' AS field, 'Cannot convert ''price'' value ''' || price || ''' to DECIMAL' AS message, price AS raw_value
FROM raw WHERE price LIKE '$%'""")
def coerce_errors(spark, sf):
    found = _parsed(spark, sf).select(F.col("_seq").alias("k"), F.explode("_errors").alias("e"))
    return found.filter("e.field = 'price'").select("k", "e.field", "e.message", "e.raw_value")


@register("required_missing", "PRJ-11", PARSE_SQL + """
SELECT k, 'buyer' AS field, 'Required field ''buyer'' is missing or empty' AS message, 'ERROR' AS severity
FROM raw WHERE buyer = ''""")
def required_missing(spark, sf):
    found = _parsed(spark, sf).select(F.col("_seq").alias("k"), F.explode("_errors").alias("e"))
    return found.filter("e.field = 'buyer'").select("k", "e.field", "e.message", "e.severity")


@register("default_fill", "PRJ-12", PARSE_SQL + "SELECT k, CASE WHEN memo = '' THEN 'none' ELSE memo END AS memo FROM raw")
def default_fill(spark, sf):
    return _parsed(spark, sf).select(F.col("_seq").alias("k"), F.col("f_memo").alias("memo"))


@register("missing_column", "PRJ-13", "SELECT o_orderkey AS k, CAST(NULL AS VARCHAR) AS note, 'Column ''NOTE'' not found in header' AS message FROM orders")
def missing_column(spark, sf):
    spec = load_spec({"id": "m", "format": "CSV", "hasHeader": True, "fields": [
        {"name": "id", "type": "LONG", "columnName": "ID"}, {"name": "note", "columnName": "NOTE"}]})
    rows = table(spark, sf, "orders")
    lines = rows.select(F.lit(None).cast("string").alias("_file"), F.col("o_orderkey").alias("_seq"),
                        F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("_raw"))
    parsed = parse_delimited(lines, spec, header="id,status")
    return parsed.select(F.col("_seq").alias("k"), F.col("f_note").alias("note"), F.col("_errors")[0]["message"].alias("message"))


@register("short_line", "PRJ-14", """
SELECT o_orderkey AS k, CASE WHEN length(o_orderpriority) > 6 THEN substr(o_orderpriority, 7, 4) END AS tail,
  CASE WHEN length(o_orderpriority) <= 6 THEN 'Line too short to extract field ''tail'' at position 6' END AS message FROM orders""")
def short_line(spark, sf):
    spec = FileSpec("s", "s", "FIXED_WIDTH", (FieldSpec("tail", start_position=6, length=4),))
    rows = table(spark, sf, "orders")
    lines = rows.select(F.lit(None).cast("string").alias("_file"), F.col("o_orderkey").alias("_seq"), F.col("o_orderpriority").alias("_raw"))
    parsed = parse_fixed_width(lines, spec)
    return parsed.select(F.col("_seq").alias("k"), F.col("f_tail").alias("tail"), F.get("_errors", F.lit(0)).getField("message").alias("message"))


_PIPED = " || '|' || ".join(ORDER_FIELDS)


@register("raw_keep", "PRJ-02", PARSE_SQL + f"SELECT k, {_PIPED} AS raw FROM raw")
def raw_keep(spark, sf):
    return _parsed(spark, sf).select(F.col("_seq").alias("k"), F.col("_raw").alias("raw"))


@register("metadata_attach", "PRJ-16", "SELECT o_orderkey AS k, 'orders.txt' AS source, o_orderstatus AS status FROM orders")
def metadata_attach(spark, sf):
    spec = FileSpec("m", "m", "CUSTOM", (FieldSpec("o_orderstatus"),))
    records = from_columns(table(spark, sf, "orders"), spec, seq="o_orderkey")
    marked = attach_metadata(records, {"source": "orders.txt", "status": F.col("f_o_orderstatus")})
    return marked.select(F.col("_seq").alias("k"), read_metadata("source").alias("source"), read_metadata("status").alias("status"))


# --- corrections ----------------------------------------------------------------------

def _correction(name, ids, src, key, value, kind, arg, expected, fmt=None, pad_char=None):
    sql = f"""SELECT k, {expected} AS value, ({expected}) IS DISTINCT FROM v AS corrected
    FROM (SELECT {key} AS k, {value} AS v FROM {src})"""

    @register(name, ids, sql)
    def run(spark, sf):
        rows = columns(spark, sf, src, {"k": key, "value": value})
        spec = FileSpec("c", "c", "CUSTOM", (FieldSpec("value", format=fmt),),
                        correction_rules=(CorrectionRule("r", "value", kind, arg, 0, pad_char),))
        done = apply_corrections(from_columns(rows, spec, seq="k"), spec)
        return done.select(F.col("_seq").alias("k"), F.col("f_value").alias("value"), F.col("_corrected").alias("corrected"))


WS = r"[\s\x{0b}\x{1c}-\x{1f}\p{Z}]+"
_correction("cor_trim", "COR-01", "documents", "doc_id", "chr(9) || text || chr(160) || ' '", "TRIM", None,
            f"regexp_replace(regexp_replace(v, '^{WS}', ''), '{WS}$', '')")
_correction("cor_trim_leading", "COR-02", "documents", "doc_id", "chr(160) || ' ' || text || '  '", "TRIM_LEADING", None,
            f"regexp_replace(v, '^{WS}', '')")
_correction("cor_trim_trailing", "COR-03", "documents", "doc_id", "' ' || text || chr(10) || ' '", "TRIM_TRAILING", None,
            f"regexp_replace(v, '{WS}$', '')")
_correction("cor_upper", "COR-04", "pages", "page_id", "url", "UPPERCASE", None, "upper(v)")
_correction("cor_lower", "COR-05", "documents", "doc_id", "text", "LOWERCASE", None, "lower(v)")
_correction("cor_title", "COR-06", "part", "p_partkey", "upper(p_name) || ' o' || chr(39) || 'neil mc-donald'", "TITLE_CASE", None,
            "array_to_string(list_transform(string_split(lower(v), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")
DATES = (
    f"CASE o_orderpriority WHEN '1-URGENT' THEN replace({DAY}, '-', '') "
    f"WHEN '2-HIGH' THEN substr({DAY}, 6, 2) || '/' || substr({DAY}, 9, 2) || '/' || substr({DAY}, 1, 4) "
    f"WHEN '3-MEDIUM' THEN replace({DAY}, '-', '/') WHEN '5-LOW' THEN 'not-a-date' ELSE {DAY} END"
)
_correction(
    "cor_date", "COR-07", "orders", "o_orderkey", DATES, "DATE_FORMAT_COERCE", "yyyy-MM-dd",
    "CASE WHEN v = 'not-a-date' THEN v WHEN length(v) = 8 THEN substr(v, 1, 4) || '-' || substr(v, 5, 2) || '-' || substr(v, 7, 2) "
    "WHEN substr(v, 3, 1) = '/' THEN substr(v, 7, 4) || '-' || substr(v, 1, 2) || '-' || substr(v, 4, 2) ELSE replace(v, '/', '-') END",
)
_correction("cor_number", "COR-08", "orders", "o_orderkey",
            "CASE o_orderstatus WHEN 'F' THEN '$ ' || " + PRICE + " WHEN 'O' THEN '£' || '1,' || " + PRICE + " ELSE " + PRICE + " END",
            "NUMBER_FORMAT_COERCE", None, "replace(replace(replace(replace(v, '$', ''), ' ', ''), ',', ''), '£', '')")
_correction("cor_default_null", "COR-09", "orders", "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END",
            "DEFAULT_IF_NULL", "PENDING", "coalesce(v, 'PENDING')")
_correction("cor_default_empty", "COR-10", "orders", "o_orderkey",
            "CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN ' ' || chr(9) ELSE o_orderstatus END",
            "DEFAULT_IF_EMPTY", "N/A", "CASE WHEN v = 'O' THEN v ELSE 'N/A' END")
_correction("cor_pad_left", "COR-11", "orders", "o_orderkey", "CAST(o_custkey AS STRING)", "PAD_LEFT", "3",
            "CASE WHEN length(v) < 3 THEN lpad(v, 3, '0') ELSE v END")
_correction("cor_pad_right", "COR-12", "part", "p_partkey", "p_name", "PAD_RIGHT", "10",
            "CASE WHEN length(v) < 10 THEN rpad(v, 10, ' ') ELSE v END")
_correction("cor_special", "COR-13", "documents", "doc_id", "text", "REMOVE_SPECIAL_CHARS", None,
            "regexp_replace(v, '[^a-zA-Z0-9 ]', '', 'g')")
_correction("cor_regex", "COR-14", "pages", "page_id", "html", "REGEX_REPLACE", r"<([a-z]+) -> [$1",
            r"regexp_replace(v, '<([a-z]+)', '[\1', 'g')")
_correction("cor_pad_char", "COR-17", "part", "p_partkey", "p_brand", "PAD_LEFT", "12",
            "CASE WHEN length(v) < 12 THEN lpad(v, 12, '*') ELSE v END", pad_char="*")


@register("cor_order", "COR-00, SRT-03", """
SELECT o_orderkey AS k, lpad(replace(upper(o_orderpriority), ' ', ''), 16, '0') AS value,
  2 + CAST(strpos(o_orderpriority, ' ') > 0 AS INT) - CAST(length(replace(o_orderpriority, ' ', '')) >= 16 AS INT)  AS n_changes FROM (
  SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM orders)""")
def cor_order(spark, sf):
    """Spec order is not apply order: upper first, then the regex, then the pad."""
    rows = columns(spark, sf, "orders", {"k": "o_orderkey", "value": "lower(o_orderpriority)"})
    spec = load_spec({"id": "c", "format": "CUSTOM", "fields": [{"name": "value"}], "correctionRules": [
        {"ruleId": "a", "field": "value", "correctionType": "PAD_LEFT", "value": "16", "applyOrder": 9},
        {"ruleId": "b", "field": "value", "correctionType": "REMOVE_SPACES", "applyOrder": 5},
        {"ruleId": "c", "field": "value", "correctionType": "UPPERCASE", "applyOrder": 1}]})
    from specflow.operators.correct import register_correction

    register_correction("REMOVE_SPACES", lambda c, rule, f: F.replace(c, F.lit(" "), F.lit("")))
    done = apply_corrections(from_columns(rows, spec, seq="k"), spec)
    return done.select(F.col("_seq").alias("k"), F.col("f_value").alias("value"), F.size("_corrections").alias("n_changes"))


@register("cor_log", "COR-15", ORDER_SQL + """
SELECT k, 'stage' AS field, stage AS original, upper(stage) AS corrected, 'UPPERCASE' AS type FROM judged WHERE stage <> upper(stage)
UNION ALL SELECT k, 'price', price, price_ok, 'NUMBER_FORMAT_COERCE' FROM judged WHERE price <> price_ok
UNION ALL SELECT k, 'placed', placed, placed_ok, 'DATE_FORMAT_COERCE' FROM judged WHERE placed <> placed_ok""")
def cor_log(spark, sf):
    done = apply_corrections(_parsed(spark, sf), ORDER_SPEC)
    return done.select(F.col("_seq").alias("k"), F.explode("_corrections").alias("c")).select(
        "k", "c.field", "c.original", "c.corrected", "c.type")


@register("cor_wildcard", "COR-16", "SELECT s_suppkey AS k, upper(s_name) AS name, 'S' || CAST(s_nationkey AS STRING) || 'X' AS nation FROM supplier")
def cor_wildcard(spark, sf):
    rows = columns(spark, sf, "supplier", {"k": "s_suppkey", "name": "' ' || lower(s_name) || ' '", "nation": "' s' || CAST(s_nationkey AS STRING) || 'x '"})
    spec = load_spec({"id": "w", "format": "CUSTOM", "fields": [{"name": "name"}, {"name": "nation"}], "correctionRules": [
        {"type": "TRIM", "fields": ["*"], "applyOrder": 1}, {"type": "UPPER_CASE", "fields": ["*"], "applyOrder": 2}]})
    done = apply_corrections(from_columns(rows, spec, seq="k"), spec)
    return done.select(F.col("_seq").alias("k"), F.col("f_name").alias("name"), F.col("f_nation").alias("nation"))


# --- validations ----------------------------------------------------------------------

def _rule(name, ids, src, key, value, kind, arg, second, expected):
    """Violations of one rule; ``expected`` is the SQL condition over v."""
    @register(name, ids, f"SELECT k, coalesce({expected}, false) AS violated FROM (SELECT {key} AS k, {value} AS v FROM {src})")
    def run(spark, sf):
        rows = columns(spark, sf, src, {"k": key, "value": value})
        spec = FileSpec("v", "v", "CUSTOM", (FieldSpec("value"),),
                        validation_rules=(ValidationRule("r", "value", kind, arg, second, "bad"),))
        done = apply_validations(from_columns(rows, spec, seq="k"), spec)
        return done.select(F.col("_seq").alias("k"), (F.size("_errors") > 0).alias("violated"))


NULLED = "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN '  ' ELSE o_orderpriority END"
NUMBERISH = f"CASE WHEN o_orderstatus = 'P' THEN 'abc' WHEN o_orderpriority = '5-LOW' THEN '-' || {PRICE} ELSE {PRICE} END"
_rule("val_not_null", "VAL-01", "orders", "o_orderkey", NULLED, "NOT_NULL", None, None, "v IS NULL")
_rule("val_not_empty", "VAL-02, VAL-18", "orders", "o_orderkey", NULLED, "NOT_EMPTY", None, None, "v IS NULL OR trim(v) = ''")
_rule("val_min_length", "VAL-03", "documents", "doc_id", "text", "MIN_LENGTH", "800", None, "length(v) < 800")
_rule("val_max_length", "VAL-04", "documents", "doc_id", "text", "MAX_LENGTH", "1500", None, "length(v) > 1500")
_rule("val_exact_length", "VAL-05", "orders", "o_orderkey", "o_orderpriority", "EXACT_LENGTH", "8", None, "length(v) <> 8")
_rule("val_regex", "VAL-06", "pages", "page_id", "url", "REGEX", r"https?://[a-z0-9.]+/[a-z]{2}/[0-9]+.*", None,
      r"NOT regexp_full_match(v, 'https?://[a-z0-9.]+/[a-z]{2}/[0-9]+.*')")
_rule("val_min_value", "VAL-07", "orders", "o_orderkey", NUMBERISH, "MIN_VALUE", "0.01", None, "TRY_CAST(v AS DECIMAL(18,2)) < 0.01")
_rule("val_max_value", "VAL-08", "orders", "o_orderkey", NUMBERISH, "MAX_VALUE", "250000", None, "TRY_CAST(v AS DECIMAL(18,2)) > 250000")
_rule("val_between", "VAL-09, VAL-20", "orders", "o_orderkey", NUMBERISH, "BETWEEN", "1000.5", "300000", "TRY_CAST(v AS DECIMAL(18,2)) NOT BETWEEN 1000.5 AND 300000")
_rule("val_allowed", "VAL-10", "events", "event_id", "event_type", "ALLOWED_VALUES", "click, view ,signup", None, "v NOT IN ('click','view','signup')")
_rule("val_expr", "VAL-11, EXT-06", "documents", "doc_id", "text", "CUSTOM_EXPRESSION", "instr(f_value, 'the') > 0 AND length(f_value) < 5000", None,
      "NOT (strpos(v, 'the') > 0 AND length(v) < 5000)")
_rule("val_date_range", "VAL-19", "orders", "o_orderkey", DAY, "DATE_RANGE", "1996-01-01", "1999-12-31", "v < '1996-01-01' OR v > '1999-12-31'")
_rule("val_positive", "VAL-20", "orders", "o_orderkey", NUMBERISH, "POSITIVE_NUMBER", None, None, "TRY_CAST(v AS DECIMAL(18,2)) <= 0")
ABA = "lpad(CAST((o_orderkey * 7919 + o_custkey) AS STRING), 9, '0')"
_rule("val_aba", "VAL-21", "orders", "o_orderkey", ABA, "ROUTING_CHECKSUM", None, None,
      "NOT (regexp_full_match(v, '[0-9]{9}') AND (3 * (TRY_CAST(v[1] AS INT) + TRY_CAST(v[4] AS INT) + TRY_CAST(v[7] AS INT)) + 7 * (TRY_CAST(v[2] AS INT) + TRY_CAST(v[5] AS INT) + TRY_CAST(v[8] AS INT)) + TRY_CAST(v[3] AS INT) + TRY_CAST(v[6] AS INT) + TRY_CAST(v[9] AS INT)) % 10 = 0)")


@register("val_cross_field", "VAL-12", "SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE NOT (l_quantity * 100 <= l_extendedprice)) AS n_violated FROM lineitem GROUP BY l_orderkey")
def val_cross_field(spark, sf):
    rows = columns(spark, sf, "lineitem", {"k": "l_orderkey", "least": "CAST(CAST(l_quantity * 100 AS DECIMAL(18,2)) AS STRING)",
                                           "price": "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"})
    spec = FileSpec("v", "v", "CUSTOM", (FieldSpec("least"), FieldSpec("price")),
                    validation_rules=(ValidationRule("r", "least", "CROSS_FIELD", "<= price", None, "too cheap"),))
    done = apply_validations(from_columns(rows, spec, seq="k"), spec)
    return done.groupBy(F.col("_seq").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("_errors") > 0).alias("n_violated"))


def _constraint(name, ids, src, key, value, f: FieldSpec, expected, message):
    @register(name, ids, f"SELECT k, {message} AS message FROM (SELECT {key} AS k, {value} AS v FROM {src}) WHERE {expected}")
    def run(spark, sf):
        rows = columns(spark, sf, src, {"k": key, "value": value})
        spec = FileSpec("v", "v", "CUSTOM", (f,))
        done = apply_validations(from_columns(rows, spec, seq="k"), spec)
        return done.select(F.col("_seq").alias("k"), F.explode("_errors").alias("e")).select("k", "e.message")


_constraint("fld_regex", "VAL-13", "orders", "o_orderkey", "o_orderpriority", FieldSpec("value", validation_regex="[1-3]-[A-Z]+"),
            "NOT regexp_full_match(v, '[1-3]-[A-Z]+')", "'Field ''value'' value ''' || v || ''' does not match required pattern'")
_constraint("fld_min_length", "VAL-14", "documents", "doc_id", "text", FieldSpec("value", min_length=600), "length(v) < 600",
            "'Field ''value'' length ' || CAST(length(v) AS STRING) || ' is below minimum 600'")
_constraint("fld_max_length", "VAL-15", "documents", "doc_id", "text", FieldSpec("value", max_length=2000), "length(v) > 2000",
            "'Field ''value'' length ' || CAST(length(v) AS STRING) || ' exceeds maximum 2000'")
_constraint("fld_allowed", "VAL-16", "events", "event_id", "event_type", FieldSpec("value", allowed_values=("click", "view")),
            "v NOT IN ('click', 'view')", "'Field ''value'' value ''' || v || ''' not in allowed values: [click, view]'")
_constraint("val_iban", "VAL-22", "orders", "o_orderkey",
            "CASE o_orderstatus WHEN 'P' THEN 'de' ELSE 'DE' END || lpad(CAST(o_custkey AS STRING), 2, '0') || 'BANK' || lpad(CAST(o_orderkey AS STRING), 10, '0')",
            FieldSpec("value", validation_regex=checks.IBAN, sensitive=True), "v LIKE 'de%'",
            "'Field ''value'' value ''***'' does not match required pattern'")


@register("val_all", "VAL-00", ORDER_SQL + "SELECT k, CAST(n_errors AS INT) AS n_errors, CAST(wordy AS INT) AS n_warnings FROM run")
def val_all(spark, sf):
    done = processed(_parsed(spark, sf), ORDER_SPEC)
    return done.select(F.col("_seq").alias("k"), F.size("_errors").alias("n_errors"), F.size("_warnings").alias("n_warnings"))


@register("val_severity", "VAL-17", ORDER_SQL + """
SELECT severity, count(*) AS n FROM (
  SELECT 'FATAL' AS severity FROM run WHERE fatal
  UNION ALL SELECT 'ERROR' FROM run WHERE fatal
  UNION ALL SELECT 'ERROR' FROM run WHERE bad_price UNION ALL SELECT 'ERROR' FROM run WHERE dear
  UNION ALL SELECT 'ERROR' FROM run WHERE slow UNION ALL SELECT 'ERROR' FROM run WHERE bad_stage
  UNION ALL SELECT 'WARNING' FROM run WHERE wordy) GROUP BY severity""")
def val_severity(spark, sf):
    done = processed(_parsed(spark, sf), ORDER_SPEC)
    return done.select(F.explode(F.concat("_errors", "_warnings")).alias("e")).groupBy(F.col("e.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


# --- masking --------------------------------------------------------------------------

@register("mask_sensitive", "PRJ-22", "SELECT o_orderkey AS k, 'Cannot convert ''pin'' value ''***'' to INTEGER' AS message, CAST(NULL AS VARCHAR) AS raw_value FROM orders")
def mask_sensitive(spark, sf):
    rows = _one_field(spark, sf, "orders", "o_orderkey", "o_orderpriority", FieldSpec("v", column_index=1))[0]
    spec = FileSpec("p", "p", "DELIMITED", (FieldSpec("pin", "INTEGER", column_index=0, sensitive=True),), delimiter="|")
    lines = rows.select(F.lit(None).cast("string").alias("_file"), F.col("k").alias("_seq"), F.col("value").alias("_raw"))
    return parse_delimited(lines, spec).select(F.col("_seq").alias("k"), F.explode("_errors").alias("e")).select("k", "e.message", "e.raw_value")


@register("mask_prefix", "PRJ-23", "SELECT c_custkey AS k, substr(c_name, 1, 4) || '****' AS shown FROM customer")
def mask_prefix(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), masking.key_prefix(F.col("c_name")).alias("shown"))


# --- routing and summaries --------------------------------------------------------------

def _run(spark, sf, skip=False):
    return processed(_parsed(spark, sf), ORDER_SPEC, skip)


@register("route_fatal", "RTE-01", ORDER_SQL + "SELECT k FROM run WHERE NOT fatal")
def route_fatal(spark, sf):
    return route.passing(_run(spark, sf)).select(F.col("_seq").alias("k"))


@register("route_skip_invalid", "RTE-02", ORDER_SQL + "SELECT k FROM run WHERE NOT invalid")
def route_skip_invalid(spark, sf):
    return route.passing(_run(spark, sf, True)).select(F.col("_seq").alias("k"))


@register("route_pass", "RTE-03", ORDER_SQL + "SELECT k, CASE WHEN invalid THEN 'WITH_ERRORS' ELSE 'OK' END AS route FROM run WHERE NOT fatal")
def route_pass(spark, sf):
    return route.passing(_run(spark, sf)).select(F.col("_seq").alias("k"), F.col("_route").alias("route"))


@register("route_quarantine", "RTE-04, STR-22", ORDER_SQL + "SELECT k, CASE WHEN fatal THEN 'FATAL' ELSE 'SKIPPED' END AS route, CAST(n_errors AS INT) AS n_errors FROM run WHERE invalid")
def route_quarantine(spark, sf):
    return route.quarantined(_run(spark, sf, True)).select(
        F.col("_seq").alias("k"), F.col("_route").alias("route"), F.size("_errors").alias("n_errors"))


SUMMARY = """count(*) AS total_records, count(*) FILTER (WHERE NOT invalid) AS successful_records,
 count(*) FILTER (WHERE {out}) AS failed_records, count(*) FILTER (WHERE NOT ({out}) AND corrected) AS corrected_records,
 count(*) FILTER (WHERE NOT ({out}) AND wordy) AS warning_records"""


@register("run_summary", "AGG-01", ORDER_SQL + f"SELECT {SUMMARY.format(out='fatal')} FROM run")
def run_summary(spark, sf):
    return route.summarise(_run(spark, sf))


@register("run_status", "AGG-02", ORDER_SQL + f"""SELECT *, CASE WHEN failed_records > 0 AND successful_records > 0 THEN 'COMPLETED_WITH_ERRORS'
 WHEN failed_records > 0 THEN 'FAILED' WHEN warning_records > 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status
 FROM (SELECT stage, {SUMMARY.format(out='invalid')} FROM run GROUP BY stage)""")
def run_status(spark, sf):
    """One run per stage as sent."""
    lines = columns(spark, sf, "orders", ORDER).select(
        F.col("stage").alias("_file"), F.col("k").alias("_seq"), F.concat_ws("|", *ORDER_FIELDS).alias("_raw"))
    done = processed(parse_delimited(lines, ORDER_SPEC), ORDER_SPEC, True)
    return route.with_status(route.summarise(done, ("_file",))).withColumnRenamed("_file", "stage")


@register("run_success_rate", "AGG-03", ORDER_SQL + """SELECT total_records, successful_records,
 round(successful_records / total_records, 9) AS success_rate, duration_ms FROM (
 SELECT count(*) AS total_records, count(*) FILTER (WHERE NOT invalid) AS successful_records,
 (SELECT (epoch_us(max(o_orderdate)) // 1000) - (epoch_us(min(o_orderdate)) // 1000) FROM orders) AS duration_ms FROM run)""")
def run_success_rate(spark, sf):
    summary = route.with_success_rate(route.summarise(_run(spark, sf)))
    orders = table(spark, sf, "orders")
    started, completed = orders.agg(F.min("o_orderdate")).scalar(), orders.agg(F.max("o_orderdate")).scalar()
    timed = route.with_duration(summary, started.cast("timestamp"), completed.cast("timestamp"))
    return timed.select("total_records", "successful_records", F.round("success_rate", 9).alias("success_rate"), "duration_ms")


@register("error_details", "AGG-04", ORDER_SQL + """
SELECT k AS sequence_number, 'buyer' AS field, 'Required field ''buyer'' is missing or empty' AS message, 'ERROR' AS severity FROM run WHERE fatal
UNION ALL SELECT k, 'buyer', 'nobody ordered', 'FATAL' FROM run WHERE fatal
UNION ALL SELECT k, 'price', 'Cannot convert ''price'' value ''' || price || ''' to DECIMAL', 'ERROR' FROM run WHERE fatal AND bad_price
UNION ALL SELECT k, 'price', 'needs approval', 'ERROR' FROM run WHERE fatal AND dear
UNION ALL SELECT k, 'urgency', 'urgency unknown', 'ERROR' FROM run WHERE fatal AND slow
UNION ALL SELECT k, 'stage', 'Field ''stage'' value ''LIMBO'' not in allowed values: [OPEN, DONE, HELD]', 'ERROR' FROM run WHERE fatal AND bad_stage""")
def error_details(spark, sf):
    return route.error_details(_run(spark, sf)).drop("_file")


@register("errors_by_rule", "AGG-05", ORDER_SQL + """
SELECT field, rule_id, severity, count(*) AS n FROM (
 SELECT 'buyer' AS field, '-' AS rule_id, 'ERROR' AS severity FROM run WHERE fatal
 UNION ALL SELECT 'buyer', 'who', 'FATAL' FROM run WHERE fatal
 UNION ALL SELECT 'price', '-', 'ERROR' FROM run WHERE bad_price
 UNION ALL SELECT 'price', 'dear', 'ERROR' FROM run WHERE dear
 UNION ALL SELECT 'urgency', 'slow', 'ERROR' FROM run WHERE slow
 UNION ALL SELECT 'stage', '-', 'ERROR' FROM run WHERE bad_stage
 UNION ALL SELECT 'memo', 'wordy', 'WARNING' FROM run WHERE wordy) GROUP BY ALL""")
def errors_by_rule(spark, sf):
    return route.issues_by_rule(_run(spark, sf))


@register("corrections_by_type", "AGG-06", ORDER_SQL + """
SELECT field, type, count(*) AS n FROM (
 SELECT 'stage' AS field, 'UPPERCASE' AS type FROM judged WHERE stage <> upper(stage)
 UNION ALL SELECT 'price', 'NUMBER_FORMAT_COERCE' FROM judged WHERE price <> price_ok
 UNION ALL SELECT 'placed', 'DATE_FORMAT_COERCE' FROM judged WHERE placed <> placed_ok) GROUP BY ALL""")
def corrections_by_type(spark, sf):
    return route.corrections_by_type(_run(spark, sf))


@register("dry_run_summary", "SRC-32", ORDER_SQL + f"""SELECT *, CASE WHEN failed_records > 0 AND successful_records > 0 THEN 'COMPLETED_WITH_ERRORS'
 WHEN failed_records > 0 THEN 'FAILED' WHEN warning_records > 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status,
 round(successful_records / total_records, 9) AS success_rate FROM (SELECT {SUMMARY.format(out='invalid')} FROM run)""")
def dry_run_summary(spark, sf):
    return dry_run(_parsed(spark, sf), ORDER_SPEC, True).withColumn("success_rate", F.round("success_rate", 9))


@register("check_digit", "VAL-21, PRJ-19", """SELECT k, v || CAST(((10 - (3 * (CAST(v[1] AS INT) + CAST(v[4] AS INT) + CAST(v[7] AS INT))
 + 7 * (CAST(v[2] AS INT) + CAST(v[5] AS INT) + CAST(v[8] AS INT)) + CAST(v[3] AS INT) + CAST(v[6] AS INT)) % 10) % 10) AS VARCHAR) AS routing
 FROM (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS v FROM customer)""")
def check_digit(spark, sf):
    rows = columns(spark, sf, "customer", {"k": "c_custkey", "v": "lpad(CAST(c_custkey AS STRING), 8, '0')"})
    return rows.select("k", F.concat("v", checks.routing_check_digit(F.col("v"))).alias("routing"))



@register("own_rule", "EXT-04", "SELECT o_orderkey AS k, 'odd customer' AS message, 'WARNING' AS severity FROM orders WHERE o_custkey % 2 = 1")
def own_rule(spark, sf):
    """A rule type that the user registers, used by name in a spec."""
    register_rule("MULTIPLE_OF", lambda value, rule: value.cast("bigint") % int(rule.value) != 0)
    spec = load_spec({"id": "own", "format": "CSV", "fields": [{"name": "customer", "type": "LONG", "columnIndex": 0}], "validationRules": [
        {"ruleId": "even", "field": "customer", "ruleType": "MULTIPLE_OF", "value": "2", "message": "odd customer", "severity": "WARNING"}]})
    rows = columns(spark, sf, "orders", {"k": "o_orderkey", "customer": "CAST(o_custkey AS STRING)"})
    done = apply_validations(from_columns(rows, spec, seq="k"), spec)
    return done.select(F.col("_seq").alias("k"), F.explode("_warnings").alias("w")).select("k", "w.message", "w.severity")

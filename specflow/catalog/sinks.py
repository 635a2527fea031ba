"""Mapping, envelope, generator and writer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from specflow.catalog.base import DAY, ORDER_SPEC, ORDER_SQL, PRICE, columns, order_lines, register
from specflow.catalog.sources import write_files
from specflow.functions import templates
from specflow.operators.mapping import map_fields
from specflow.operators.ordered import row_numbers
from specflow.operators.records import from_columns, pinned
from specflow.plans.inbound import processed
from specflow.session import table, work_path
from specflow.sinks import generators, nacha, register_sink, write, writers
from specflow.sinks.envelope import envelopes
from specflow.sources.delimited import parse_delimited
from specflow.sources.lines import number_lines, read_lines
from specflow.sources.listing import archived_copies
from specflow.sources.payments import nacha_entries
from specflow.operators.route import passing
from specflow.spec import FieldMapping, FieldSpec, FileSpec

EVENT_SPEC = FileSpec("pay", "pay", "CUSTOM", tuple(FieldSpec(n, required=False, nullable=True) for n in ("account", "amount", "kind", "day", "note")))
EVENT_FIELDS = {
    "k": "o_orderkey", "account": "'ac' || CAST(o_custkey AS STRING)", "amount": f"CASE WHEN o_orderstatus = 'P' THEN '12' ELSE {PRICE} END",
    "kind": "CASE WHEN o_orderstatus = 'F' THEN '27' END", "day": DAY, "note": "' ' || lower(o_orderpriority) || ' '",
}


def pay_events(spark, sf):
    return from_columns(columns(spark, sf, "orders", EVENT_FIELDS), EVENT_SPEC, seq="k")


def _mapped(name, ids, mapping, sql, order=()):
    @register(name, ids, f"SELECT o_orderkey AS k, {sql} FROM orders")
    def run(spark, sf):
        done = map_fields(pay_events(spark, sf), tuple(mapping), order)
        names = [c for c in done.columns if c.startswith("f_")]
        return done.select(F.col("_seq").alias("k"), *[F.col(n).alias(n[2:]) for n in names])


_mapped("map_fields", "PRJ-17", [FieldMapping("account", "accountNo"), FieldMapping("day", "entryDate")],
        f"'ac' || CAST(o_custkey AS VARCHAR) AS \"accountNo\", {DAY} AS \"entryDate\"")
_mapped("map_default", "PRJ-18", [FieldMapping("kind", "code", default_value="22"), FieldMapping("absent", "fixed", default_value="X")],
        "CASE WHEN o_orderstatus = 'F' THEN '27' ELSE '22' END AS code, 'X' AS fixed")
_mapped("map_transforms", "PRJ-19", [
    FieldMapping("note", "upper", "UPPERCASE"), FieldMapping("note", "trimmed", "TRIM"), FieldMapping("account", "padded", "PAD_LEFT:12"),
    FieldMapping("day", "short", "FORMAT_DATE"), FieldMapping("amount", "money", "FORMAT_DECIMAL_2DP")],
    f"""' ' || upper(o_orderpriority) || ' ' AS upper, lower(o_orderpriority) AS trimmed, lpad('ac' || CAST(o_custkey AS VARCHAR), 12, '0') AS padded,
    replace(substr({DAY}, 3), '-', '') AS short, CASE WHEN o_orderstatus = 'P' THEN '12.00' ELSE {PRICE} END AS money""")
_mapped("map_expr", "PRJ-20, EXT-06", [FieldMapping("day", "year", transformation="substring(value, 1, 4)"), FieldMapping("account", "tail", transformation="right(value, 2)")],
        f"substr({DAY}, 1, 4) AS year, right('ac' || CAST(o_custkey AS VARCHAR), 2) AS tail")


@register("map_order", "PRJ-21", f"SELECT o_orderkey AS k, 'day,account,amount' AS field_order, {DAY} || ',ac' || CAST(o_custkey AS VARCHAR) AS line FROM orders")
def map_order(spark, sf):
    mappings = (FieldMapping("amount", "amount"), FieldMapping("account", "account"), FieldMapping("day", "day"))
    done = map_fields(pay_events(spark, sf), mappings, ("day", "account"))
    names = [c[2:] for c in done.columns if c.startswith("f_")]
    return done.select(F.col("_seq").alias("k"), F.lit(",".join(names)).alias("field_order"), F.concat_ws(",", "f_day", "f_account").alias("line"))


RUN = "11111111-2222-3333-4444-555555555555"


def _passed(spark, sf):
    return passing(processed(parse_delimited(order_lines(spark, sf), ORDER_SPEC), ORDER_SPEC))


@register("event_envelope", "PRJ-24, PRJ-25", ORDER_SQL + f"""SELECT k, '{RUN}' AS run, 'shop-orders' AS spec, 'orders.txt' AS file, corrected,
 CASE WHEN bad_price THEN '"' || price_ok || '"' ELSE CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) END AS price, upper(stage) AS stage FROM run WHERE NOT fatal""")
def event_envelope(spark, sf):
    """The JSON event read back: numbers stay numbers unless a correction made them text."""
    made = envelopes(_passed(spark, sf), ORDER_SPEC, RUN, stamp=F.lit(0))
    made = pinned(made.select(F.parse_json("value").alias("v")), ["v"])
    v = F.col("v")
    price = F.variant_get(v, "$.fields.price", "variant")
    shown = F.when(F.schema_of_variant(price) == "STRING", F.to_json(price)).otherwise(F.variant_get(v, "$.fields.price", "decimal(18,2)").cast("string"))
    return made.select(
        F.variant_get(v, "$.sequenceNumber", "bigint").alias("k"), F.variant_get(v, "$.correlationId", "string").alias("run"),
        F.variant_get(v, "$.specId", "string").alias("spec"), F.variant_get(v, "$.fileName", "string").alias("file"),
        F.variant_get(v, "$.corrected", "boolean").alias("corrected"), shown.alias("price"), F.variant_get(v, "$.fields.stage", "string").alias("stage"))


@register("sink_kafka_frame", "SNK-01", ORDER_SQL + f"""SELECT '{RUN}' AS key, '{{"correlationId":"{RUN}","specId":"shop-orders","sequenceNumber":' || k || ',"fileName":"orders.txt","fields":{{"placed":"' || placed_ok || '","orderNo":"' || order_no
 || '","price":"' || price_ok || '","buyer":"' || buyer || '","stage":"' || upper(stage) || '","urgency":"' || urgency || '","memo":"' || memo_ok || '"}},"corrected":'
 || CASE WHEN corrected THEN 'true' ELSE 'false' END || ',"metadata":{{}},"eventTimestamp":0}}' AS value FROM run WHERE NOT fatal""")
def sink_kafka_frame(spark, sf):
    """Key and value as they go to the topic, fields as text."""
    return envelopes(_passed(spark, sf), ORDER_SPEC, RUN, text_only=True, stamp=F.lit(0))


@register("storage_key", "PRJ-27", f"SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) || '/' || {DAY} || '/F' || CAST(o_orderkey AS VARCHAR) || '.csv' AS storage_key FROM orders")
def storage_key(spark, sf):
    rows = table(spark, sf, "orders")
    name = F.concat(F.lit("F"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    return rows.select(F.col("o_orderkey").alias("k"), templates.storage_key(F.col("o_custkey"), F.col("o_orderdate"), name).alias("storage_key"))


@register("path_template", "PRJ-28", "SELECT o_orderkey AS k, 'archives/' || o_custkey || '/' || strftime(o_orderdate, '%Y/%m') || '/W' || o_orderkey || '.gz' AS path, 'output_pay_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '.csv' AS file FROM orders")
def path_template(spark, sf):
    rows = table(spark, sf, "orders")
    parts = templates.date_parts(F.col("o_orderdate"))
    path = templates.render("archives/{profileId}/{year}/{month}/{windowId}.gz", {**parts, "profileId": F.col("o_custkey"), "windowId": F.concat(F.lit("W"), "o_orderkey")})
    file = templates.render("output_{specId}_{timestamp}.{ext}", {**parts, "specId": "pay", "ext": "csv"})
    return rows.select(F.col("o_orderkey").alias("k"), path.alias("path"), file.alias("file"))


# --- generators -----------------------------------------------------------------------

def _doc_records(spark, sf):
    spec = FileSpec("doc", "doc", "CUSTOM", (FieldSpec("source"), FieldSpec("text"), FieldSpec("lang")))
    return from_columns(table(spark, sf, "documents"), spec, seq="doc_id")


@register("gen_csv", "SNK-04, EXT-05", """SELECT doc_id AS k, source || ',' || CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang AS line FROM documents""")
def gen_csv(spark, sf):
    return _doc_records(spark, sf).select(F.col("_seq").alias("k"), generators.line_of("CSV", ["source", "text", "lang"]).alias("line"))


@register("gen_fixed_width", "SNK-05", f"SELECT o_orderkey AS k, rpad('ac' || CAST(o_custkey AS VARCHAR), 12, ' ') || lpad(CASE WHEN o_orderstatus = 'P' THEN '12' ELSE {PRICE} END, 14, '0') || {DAY} AS line FROM orders")
def gen_fixed_width(spark, sf):
    line = generators.line_of("FIXED_WIDTH", ["account", "amount", "day"], widths={"account": 12, "amount": 14, "day": 10}, numeric={"amount"})
    return pay_events(spark, sf).select(F.col("_seq").alias("k"), line.alias("line"))


@register("gen_json", "SNK-08", f"""SELECT o_orderkey AS k, '{{"account":"ac' || o_custkey || '","kind":' || CASE WHEN o_orderstatus = 'F' THEN '"27"' ELSE 'null' END || ',"day":"' || {DAY} || '"}}' AS line FROM orders""")
def gen_json(spark, sf):
    return pay_events(spark, sf).select(F.col("_seq").alias("k"), generators.line_of("JSON", ["account", "kind", "day"]).alias("line"))


@register("gen_xml", "SNK-08", """SELECT doc_id AS k, '<doc><source>' || source || '</source><text>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text></doc>' AS line FROM documents""")
def gen_xml(spark, sf):
    return _doc_records(spark, sf).select(F.col("_seq").alias("k"), generators.line_of("XML", ["source", "text"], tag="doc").alias("line"))


@register("gen_swift", "SNK-07", f"SELECT o_orderkey AS k, '{{4:' || chr(10) || ':20:ac' || o_custkey || chr(10) || ':30:' || {DAY} || chr(10) || '-}}' AS line FROM orders")
def gen_swift(spark, sf):
    line = generators.line_of("SWIFT_MT", ["account", "day"], tags={"account": "20", "day": "30"})
    return pay_events(spark, sf).select(F.col("_seq").alias("k"), line.alias("line"))


BATCHES = f"""WITH e AS (SELECT o_orderkey AS k, o_custkey AS c, {DAY} AS day, CASE WHEN o_orderstatus = 'F' THEN '27' ELSE '22' END AS code, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS routing,
 CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
 t AS (SELECT day, count(*) AS n, coalesce(sum(cents) FILTER (WHERE code = '27'), 0)::BIGINT AS debit, coalesce(sum(cents) FILTER (WHERE code = '22'), 0)::BIGINT AS credit,
 (sum(CAST(substr(routing, 1, 8) AS BIGINT)) % 10000000000)::BIGINT AS hash FROM e GROUP BY day) """


def entries(spark, sf):
    return columns(spark, sf, "orders", {
        "k": "o_orderkey", "c": "CAST(o_custkey AS STRING)", "day": DAY, "code": "CASE WHEN o_orderstatus = 'F' THEN '27' ELSE '22' END", "routing": "lpad(CAST(o_custkey AS STRING), 9, '0')",
        "cents": "CAST(round(o_totalprice * 100) AS BIGINT)"})


def _totals(spark, sf):
    return generators.totals(entries(spark, sf), ["day"], F.col("cents"), F.col("code"), F.col("routing"))


@register("nacha_control", "AGG-12", BATCHES + """SELECT day, n AS "entryCount", debit AS "totalDebit", credit AS "totalCredit", hash AS "entryHash", 1::BIGINT AS "batchCount", ceil((n + 4) / 10)::BIGINT AS "blockCount" FROM t""")
def nacha_control(spark, sf):
    return _totals(spark, sf)


FOOTER = "TOTAL entries={entryCount:9} out={totalDebit:15} in={totalCredit:15} check={entryHash:10}"
FOOTER_SQL = "'TOTAL entries=' || lpad(CAST(n AS VARCHAR), 9, '0') || ' out=' || lpad(CAST(debit AS VARCHAR), 15, '0') || ' in=' || lpad(CAST(credit AS VARCHAR), 15, '0') || ' check=' || lpad(CAST(hash AS VARCHAR), 10, '0')"


@register("gen_footer", "SNK-09", BATCHES + f"SELECT day, {FOOTER_SQL} AS line FROM t")
def gen_footer(spark, sf):
    totals = _totals(spark, sf)
    values = {c: F.col(c) for c in totals.columns}
    return totals.select("day", templates.render(FOOTER, values, generators.NUMERIC_TOTALS).alias("line"))


# Cells of the files below that are the same in every line.
BANK = {
    "destination": "091000019", "origin": "1987654321", "created_on": "260101", "created_at": "0600", "modifier": "A",
    "destination_name": "PRAIRIE BANK", "origin_name": "ORDER HOUSE", "reference": "", "service_class": "200",
    "company_name": "ORDER HOUSE", "company_data": "", "company_id": "1987654321", "entry_class": "PPD", "description": "ORDERS",
    "described_on": "", "effective_on": "260102", "originator": "09100001", "batch_no": "1", "individual_name": "SHOP",
}
NACHA_SQL = BATCHES + """SELECT day, 0::BIGINT AS line_no, '101' || lpad('091000019', 10, ' ') || '1987654321' || '260101' || '0600' || 'A' || '094' || '10' || '1' || rpad('PRAIRIE BANK', 23, ' ') || rpad('ORDER HOUSE', 23, ' ') || rpad('', 8, ' ') AS line FROM t
 UNION ALL SELECT day, 1, '5200' || rpad('ORDER HOUSE', 16, ' ') || rpad('', 20, ' ') || '1987654321' || 'PPD' || rpad('ORDERS', 10, ' ') || rpad('', 6, ' ') || '260102' || '   ' || '1' || '09100001' || '0000001' FROM t
 UNION ALL SELECT day, row_number() OVER w + 1, '6' || code || routing || rpad('AC' || c, 17, ' ') || lpad(CAST(cents AS VARCHAR), 10, '0') || rpad(CAST(k AS VARCHAR), 15, ' ') || rpad('SHOP', 22, ' ') || '  0' || '09100001' || lpad(CAST(row_number() OVER w AS VARCHAR), 7, '0') FROM e WINDOW w AS (PARTITION BY day ORDER BY k)
 UNION ALL SELECT day, n + 2, '8200' || lpad(CAST(n AS VARCHAR), 6, '0') || lpad(CAST(hash AS VARCHAR), 10, '0') || lpad(CAST(debit AS VARCHAR), 12, '0') || lpad(CAST(credit AS VARCHAR), 12, '0') || '1987654321' || rpad('', 25, ' ') || '09100001' || '0000001' FROM t
 UNION ALL SELECT day, n + 3, '9' || '000001' || lpad(CAST(ceil((n + 4) / 10)::BIGINT AS VARCHAR), 6, '0') || lpad(CAST(n AS VARCHAR), 8, '0') || lpad(CAST(hash AS VARCHAR), 10, '0') || lpad(CAST(debit AS VARCHAR), 12, '0') || lpad(CAST(credit AS VARCHAR), 12, '0') || rpad('', 39, ' ') FROM t
 UNION ALL SELECT day, n + 4 + i, repeat('9', 94) FROM t, range(10) r(i) WHERE i < (10 - (n + 4) % 10) % 10"""


#: entries of a bank file
FILE_ENTRIES = 1_000


def _bank_files(spark, sf, key="day", size=None):
    """A file per day, or of ``size`` entries at most per year: headers, entries, controls and filler lines, in blocks of ten."""
    rows = entries(spark, sf).withColumn("year", F.substring("day", 1, 4)).withColumn("account", F.concat(F.lit("AC"), "c")).withColumn("individual_id", F.col("k"))
    numbered = row_numbers(rows, (key,), ("k",), "nth")
    if size is None:
        return nacha.files(numbered, [key], "nth", BANK)
    cut = numbered.withColumn("file", F.concat_ws("-", key, F.call_function("div", F.col("nth") - 1, F.lit(size)).cast("string")))
    return nacha.files(cut.withColumn("nth", (F.col("nth") - 1) % size + 1), ["file"], "nth", BANK)


@register("gen_nacha", "SNK-06", NACHA_SQL)
def gen_nacha(spark, sf):
    return _bank_files(spark, sf)


@register("nacha_roundtrip", "SNK-06, SRC-18", BATCHES + "SELECT k, substr(day, 1, 4) AS year, 'AC' || c AS account, code, CAST(cents / 100 AS DECIMAL(18,2))::VARCHAR AS amount FROM e")
def nacha_roundtrip(spark, sf):
    """Bank files of a thousand entries written, read back as files and parsed, record for record."""
    path = work_path(spark, "bank")
    writers.write_line_files(_bank_files(spark, sf, "year", FILE_ENTRIES), path, file="file")
    lines = number_lines(read_lines(spark, path))[0]
    back = nacha_entries(lines)
    return back.select(
        F.col("f_individualId").cast("bigint").alias("k"), F.regexp_extract("_file", "/file=([0-9]+)-[0-9]+/", 1).alias("year"),
        F.col("f_account").alias("account"), F.col("f_code").alias("code"), F.col("f_amount").alias("amount"))


@register("gen_too_wide", "SNK-05, SNK-06", BATCHES + "SELECT k, 'cents' AS field, 'wider than 7' AS message, 'FATAL' AS severity, CAST(cents AS VARCHAR) AS raw_value FROM e WHERE length(CAST(cents AS VARCHAR)) > 7")
def gen_too_wide(spark, sf):
    """Numbers that a narrow column cannot hold are reported, never cut."""
    narrow = tuple((n, 7 if n == "cents" else w, k) for n, w, k in nacha.ENTRY if n in ("code", "routing", "cents"))
    found = entries(spark, sf).select("k", F.explode(nacha.unfit(narrow)).alias("i"))
    return found.select("k", "i.field", "i.message", "i.severity", "i.raw_value")


@register("gen_empty", "SNK-10", """WITH c AS (SELECT DISTINCT c_nationkey AS nation FROM customer), t AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_acctbal > 8000 GROUP BY 1)
 SELECT policy, c.nation, coalesce(n, 0) AS "entryCount", coalesce(n, 0) > 0 OR policy = 'GENERATE_EMPTY' AS has_header, coalesce(n, 0) > 0 OR policy = 'GENERATE_TRAILER' AS has_footer
 FROM c LEFT JOIN t USING (nation), (VALUES ('SKIP'), ('GENERATE_EMPTY'), ('GENERATE_TRAILER')) p(policy) WHERE coalesce(n, 0) > 0 OR policy <> 'SKIP'""")
def gen_empty(spark, sf):
    calendar = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).distinct()
    summary = table(spark, sf, "supplier").filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("entryCount"))
    made = None
    for policy in ("SKIP", "GENERATE_EMPTY", "GENERATE_TRAILER"):
        one = generators.with_empty_policy(summary, calendar, ["nation"], policy).withColumn("policy", F.lit(policy))
        made = one if made is None else made.unionByName(one)
    return made


@register("aggregation_key", "AGG-13", f"SELECT {DAY} AS file_key, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def aggregation_key(spark, sf):
    return entries(spark, sf).groupBy(F.col("day").alias("file_key")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))


# --- writers ----------------------------------------------------------------------------

@register("sink_roundtrip", "SNK-02, SNK-04", "SELECT o_orderkey AS k, 'ac' || CAST(o_custkey AS VARCHAR) AS account, upper(o_orderpriority) || ', x' AS note FROM orders")
def sink_roundtrip(spark, sf):
    """Generated, written as files of bounded size, and parsed back."""
    records = pay_events(spark, sf).withColumn("f_note", F.concat(F.upper(F.btrim("f_note")), F.lit(", x")))
    placed = generators.split_files(records.withColumn("f_k", F.col("_seq").cast("string")), (), ("_seq",), 4000)
    lines = placed.select(F.col("file_no").alias("file_name"), "line_no", generators.line_of("CSV", ["k", "account", "note"]).alias("line"))
    path = work_path(spark, "roundtrip")
    writers.write_line_files(lines, path)
    spec = FileSpec("rt", "rt", "CSV", tuple(FieldSpec(n, column_index=i) for i, n in enumerate(("k", "account", "note"))))
    back = parse_delimited(number_lines(read_lines(spark, path))[0], spec)
    return back.select(F.col("f_k").cast("bigint").alias("k"), F.col("f_account").alias("account"), F.col("f_note").alias("note"))


@register("sink_archive", "SNK-11", "SELECT fmt, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events, (VALUES ('JSONL'), ('PARQUET'), ('CSV')) f(fmt) GROUP BY ALL")
def sink_archive(spark, sf):
    """Events archived in three formats under a partitioned path, then counted from the archives."""
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    found = None
    for fmt, codec, kind in (("JSONL", "GZIP", "json"), ("PARQUET", "ZSTD", "parquet"), ("CSV", "NONE", "csv")):
        path = work_path(spark, f"archive-{kind}")
        writers.archive(ev.repartitionByRange("day", "event_id"), path, fmt, codec, ["day"])
        back = spark.read.format(kind).schema("event_id string, day string" if kind != "parquet" else "event_id bigint, day string").load(path)
        one = back.groupBy("day").agg(F.count("event_id").alias("n")).select(F.lit(fmt).alias("fmt"), "day", "n")
        found = one if found is None else found.unionByName(one)
    return found


@register("retention_expired", "SNK-12", "SELECT o_orderkey AS k FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) > 90")
def retention_expired(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    return writers.expired(rows, "day", rows.agg(F.max("day")).scalar(), 90).select("k")


@register("ledger_build", "SNK-13", "SELECT lang || '-' || doc_id AS name, md5(text) AS md5, strlen(text) AS size FROM documents")
def ledger_build(spark, sf):
    """Files as byte contents with digest and size, keyed by name."""
    docs = table(spark, sf, "documents")
    return docs.select(F.concat_ws("-", "lang", "doc_id").alias("name"), F.md5(F.encode("text", "UTF-8")).alias("md5"), F.octet_length("text").cast("bigint").alias("size"))


LEDGER_PART = 65_536


@register("ledger_files", "SNK-13, PRJ-29", f"""WITH f AS (SELECT CAST(floor(o_orderkey / 16000.0) AS BIGINT) AS b, string_agg(lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || chr(10), '' ORDER BY o_orderkey) AS body FROM orders GROUP BY 1),
 p AS (SELECT b, i, md5(substr(body, i * {LEDGER_PART} + 1, {LEDGER_PART})) AS digest FROM (SELECT b, body, unnest(range((strlen(body) + {LEDGER_PART - 1}) // {LEDGER_PART})) AS i FROM f)),
 e AS (SELECT b, count(*) AS n_parts, string_agg(digest, '' ORDER BY i) AS digests FROM p GROUP BY b)
SELECT b, strlen(body) AS file_size_bytes, n_parts, CASE WHEN n_parts = 1 THEN digests ELSE md5(unhex(digests)) || '-' || n_parts END AS etag, '' AS bucket, true AS named FROM f JOIN e USING (b)""")
def ledger_files(spark, sf):
    """Records of archived copies: files of several parts, each part digested by itself."""
    rows = columns(spark, sf, "orders", {"b": "CAST(floor(o_orderkey / 16000.0) AS BIGINT)", "k": "o_orderkey", "value": "lpad(CAST(o_orderkey AS STRING), 20, '0')"})
    copies = archived_copies(spark, write_files(rows, work_path(spark, "ledger"), ["b"]), part_bytes=LEDGER_PART)
    return copies.select(
        F.regexp_extract("key", "/b=([0-9]+)/", 1).cast("bigint").alias("b"), "file_size_bytes", "n_parts", "etag", "bucket",
        F.endswith("key", F.col("remote_file_name")).alias("named"))


@register("route_predicate", "RTE-05", f"SELECT 'big' AS route, o_orderkey AS k FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'urgent', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def route_predicate(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderpriority")
    routes = {"big": "o_totalprice > 400000", "urgent": "o_orderpriority = '1-URGENT'"}
    hit = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in routes.items()]))
    return rows.select(F.explode(hit).alias("route"), "k")


@register("route_fanout", "RTE-06, SNK-15", """SELECT route, outcome, count(*) AS n FROM (SELECT 'all' AS route, 'SUCCESS' AS outcome, event_type FROM events UNION ALL SELECT 'errors', 'SUCCESS', event_type FROM events WHERE event_type = 'error') GROUP BY ALL""")
def route_fanout(spark, sf):
    """One frame written to two places from one evaluation, then read back."""
    ev = table(spark, sf, "events").select("event_id", "event_type")
    paths = {"all": work_path(spark, "fan-all"), "errors": work_path(spark, "fan-errors")}
    conditions = {"all": None, "errors": "event_type = 'error'"}
    routes = {n: (conditions[n], lambda df, p=p: df.write.parquet(p)) for n, p in paths.items()}
    outcome = writers.fan_out(ev, routes)
    found = [spark.read.parquet(paths[n]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("route"), F.lit(outcome[n]).alias("outcome"), "n") for n in paths]
    return found[0].unionByName(found[1])



@register("own_sink", "EXT-02", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def own_sink(spark, sf):
    """A writer that the user registers, chosen by its name like the built-in ones."""
    path = work_path(spark, "own-sink")

    def by_kind(df, options):
        df.filter(F.col("event_type") != options["without"]).write.partitionBy("event_type").parquet(options["path"])

    register_sink("BY_KIND", by_kind)
    write(table(spark, sf, "events").select("event_id", "event_type"), "BY_KIND", {"path": path, "without": "view"})
    return spark.read.parquet(path).groupBy(F.col("event_type").cast("string").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))

"""Source queries: lines of a table encoded, written where a file reader is under test, and parsed back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.catalog.base import DAY, PRICE, columns, register
from specflow.commits import Files
from specflow.session import stored, table, work_path
from specflow.sources import read_records, register_reader
from specflow.sources.delimited import parse_delimited, split_quoted
from specflow.sources.lines import number_lines, read_lines
from specflow.sources.listing import matches, normalise_filter_column
from specflow.sources.payments import nacha_entries, nacha_lines, swift_tags
from specflow.sources.xml_records import parse_xml_text
from specflow.spec import FieldSpec, FileSpec, load_spec

def _lines(frame, key, line):
    return frame.select(F.lit(None).cast("string").alias("_file"), F.col(key).alias("_seq"), line.alias("_raw"))


ORDER_CSV = load_spec({
    "id": "orders-csv", "format": "CSV", "hasHeader": True, "fields": [
        {"name": "id", "type": "LONG", "columnName": "Order_Id"},
        {"name": "status", "columnName": "status"},
        {"name": "price", "type": "DECIMAL", "columnName": "PRICE", "scale": 2},
        {"name": "note", "columnName": "note", "required": False, "nullable": True}]})


# Files hold a fixed span of keys, so their number grows with the data and their size does not.
FILE_KEYS = 4000
FILE_OF = f"CAST(floor(o_orderkey / {FILE_KEYS}.0) AS BIGINT)"
# Long documents come in parts of a span of keys: some 100 MB, so that one task writes a part and several read it.
DOCUMENT_KEYS, EVENT_KEYS, TRANSACTION_KEYS = 100_000, 4_000_000, 3_000_000


def write_files(rows, path, keys):
    """One text file per key combination; columns: keys, k (order), value."""
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "k")
    placed.select(*keys, "value").write.partitionBy(*keys).text(path)
    return path


def _write_orders(spark, sf, label, header=True):
    """Orders as CSV text, one file per status and span of keys, each with its own header."""
    rows = columns(spark, sf, "orders", {
        "s": "o_orderstatus", "b": FILE_OF, "k": "o_orderkey",
        "value": f"CAST(o_orderkey AS STRING) || ',' || o_orderstatus || ',' || {PRICE} || ',\"' || o_orderpriority || ', as sent\"'"})
    if header:
        heads = rows.select("s", "b").distinct().select(
            "s", "b", F.lit(-1).cast("bigint").alias("k"), F.lit(" order_id ,STATUS,price,Note").alias("value"))
        rows = rows.unionByName(heads)
    return write_files(rows, work_path(spark, label), ["s", "b"])


@register("src_csv", "SRC-01, SRC-04, EXT-01", f"SELECT o_orderkey AS id, o_orderstatus AS status, {PRICE} AS price, o_orderpriority || ', as sent' AS note, CAST(0 AS INT) AS n_errors FROM orders")
def src_csv(spark, sf):
    """Written as files with a header each, read back by the file reader."""
    records = read_records(spark, _write_orders(spark, sf, "src-csv"), ORDER_CSV)
    return records.select(
        F.col("f_id").cast("bigint").alias("id"), F.col("f_status").alias("status"), F.col("f_price").alias("price"),
        F.col("f_note").alias("note"), F.size("_errors").alias("n_errors"))


@register("seq_numbers", "PRJ-01, WIN-01", """SELECT o_orderstatus AS status, o_orderkey AS id,
 row_number() OVER (PARTITION BY o_orderstatus, floor(o_orderkey / 4000.0) ORDER BY o_orderkey) - 1 AS seq FROM orders""")
def seq_numbers(spark, sf):
    """Dense numbers per file, over many splits of each file."""
    path = _write_orders(spark, sf, "seq")
    records = read_records(spark, path, ORDER_CSV)
    return records.select(F.col("f_status").alias("status"), F.col("f_id").cast("bigint").alias("id"), F.col("_seq").alias("seq"))


def _delimited(name, ids, delimiter):
    sql = f"SELECT o_orderkey AS k, o_orderstatus AS status, {PRICE} AS price, o_orderpriority AS priority FROM orders"

    @register(name, ids, sql)
    def run(spark, sf):
        fields = (FieldSpec("k", "LONG", column_index=3), FieldSpec("status", column_index=0), FieldSpec("price", "DECIMAL", column_index=1), FieldSpec("priority", column_index=2))
        spec = FileSpec("d", "d", "DELIMITED", fields, delimiter=delimiter)
        rows = columns(spark, sf, "orders", {"b": FILE_OF, "k": "o_orderkey", "value": f"concat_ws('{delimiter}', o_orderstatus, {PRICE}, o_orderpriority, CAST(o_orderkey AS STRING))"})
        parsed = read_records(spark, write_files(rows, work_path(spark, name), ["b"]), spec)
        return parsed.select(F.col("f_k").cast("bigint").alias("k"), F.col("f_status").alias("status"), F.col("f_price").alias("price"), F.col("f_priority").alias("priority"))


_delimited("src_delimited_pipe", "SRC-02", "|")
_delimited("src_delimited_multichar", "SRC-02", "||")
_delimited("src_delimited_tab", "SRC-02", "\t")


def escaped(text, *marks):
    """SQL text that spells the marks, and the sign it spells them with, as %XX; Spark and DuckDB share it."""
    for mark in ("%", *marks):
        text = f"replace({text}, chr({ord(mark)}), '%{ord(mark):02X}')"
    return text


def unescaped(c, *marks):
    for mark in (*marks, "%"):
        c = F.replace(c, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return c


@register("src_csv_quoted", "SRC-03", "SELECT doc_id AS k, text, source, strlen(text) > 0 AS filled FROM documents")
def src_csv_quoted(spark, sf):
    """Whole documents as quoted cells, commas and all; what such a cell cannot hold is spelled out."""
    held = escaped("text", '"', "\n", "\r")
    rows = columns(spark, sf, "documents", {"k": "doc_id", "line": f"""'"' || {held} || '",' || source"""})
    parts = split_quoted(F.col("line"), ",")
    cut = rows.select("k", parts.alias("p"))
    text = unescaped(F.get("p", F.lit(0)), '"', "\n", "\r")
    return cut.select("k", text.alias("text"), F.get("p", F.lit(1)).alias("source"), (F.length(F.get("p", F.lit(0))) > 0).alias("filled"))


@register("src_csv_header", "SRC-04", "SELECT o_orderkey AS k, o_orderpriority AS last_wins, o_orderstatus AS by_index FROM orders")
def src_csv_header(spark, sf):
    """Case and blanks do not matter, the last duplicate wins, an index beats a name."""
    spec = load_spec({"id": "h", "format": "CSV", "hasHeader": True, "fields": [
        {"name": "last", "columnName": "NOTE"}, {"name": "status", "columnName": "note", "columnIndex": 1}]})
    rows = columns(spark, sf, "orders", {"k": "o_orderkey", "line": "o_orderstatus || 'x,' || o_orderstatus || ',' || o_orderpriority"})
    parsed = parse_delimited(_lines(rows, "k", F.col("line")), spec, header=" Note ,id,nOTE ")
    return parsed.select(F.col("_seq").alias("k"), F.col("f_last").alias("last_wins"), F.col("f_status").alias("by_index"))


@register("src_csv_index", "SRC-05", "SELECT p_partkey AS k, p_name AS name, CAST(NULL AS VARCHAR) AS beyond FROM part")
def src_csv_index(spark, sf):
    spec = FileSpec("i", "i", "CSV", (FieldSpec("name", column_index=1), FieldSpec("beyond", column_index=7, required=False, nullable=True)))
    rows = columns(spark, sf, "part", {"k": "p_partkey", "line": "p_brand || ',' || p_name"})
    parsed = parse_delimited(_lines(rows, "k", F.col("line")), spec)
    return parsed.select(F.col("_seq").alias("k"), F.col("f_name").alias("name"), F.col("f_beyond").alias("beyond"))


@register("src_skip_lines", "SRC-06", """SELECT line - 3 AS seq, id FROM (SELECT c_custkey AS id,
 row_number() OVER (PARTITION BY floor(c_custkey / 400.0) ORDER BY c_custkey) - 1 AS line FROM customer) WHERE line >= 3""")
def src_skip_lines(spark, sf):
    """Two skipped lines and a header line: each file's first three lines are no records."""
    rows = columns(spark, sf, "customer", {"b": "CAST(floor(c_custkey / 400.0) AS BIGINT)", "k": "c_custkey", "value": "CAST(c_custkey AS STRING)"})
    path = write_files(rows, work_path(spark, "skip"), ["b"])
    data, _ = number_lines(read_lines(spark, path), skip=2, header=True)
    return data.select(F.col("_seq").alias("seq"), F.col("_raw").cast("bigint").alias("id"))


@register("src_blank_skip", "SRC-07", """SELECT id, row_number() OVER (PARTITION BY b ORDER BY id) - 1 AS seq, line FROM (
 SELECT o_orderkey AS id, floor(o_orderkey / 4000.0) AS b, o_orderstatus,
 row_number() OVER (PARTITION BY floor(o_orderkey / 4000.0) ORDER BY o_orderkey) - 1 AS line FROM orders) WHERE o_orderstatus <> 'P'""")
def src_blank_skip(spark, sf):
    """Orders in state P are sent as blank lines; they count as lines but not as records."""
    rows = columns(spark, sf, "orders", {
        "b": FILE_OF, "k": "o_orderkey", "value": "CASE WHEN o_orderstatus = 'P' THEN ' \t ' ELSE CAST(o_orderkey AS STRING) END"})
    data, _ = number_lines(read_lines(spark, write_files(rows, work_path(spark, "blank"), ["b"])))
    return data.select(F.col("_raw").cast("bigint").alias("id"), F.col("_seq").alias("seq"), F.col("_line").alias("line"))


def _charset(name, encoding, separator):
    @register(name, "SRC-08", "SELECT doc_id AS k, text FROM documents")
    def run(spark, sf):
        """Whole documents as lines of another charset, a blank line after each, decoded on the way in.

        The text writer keeps the bytes of its strings, so encoded lines and separators go through it.
        """
        path = work_path(spark, name)
        line = f"CAST(doc_id AS STRING) || '|' || {escaped('text', chr(10), chr(13))} || chr(10)"
        rows = columns(spark, sf, "documents", {"line": line})
        rows.select(F.encode("line", encoding).cast("string").alias("value")).write.options(**separator).text(path)
        lines = read_lines(spark, path, encoding=encoding).filter("_raw <> ''")
        cut = F.instr("_raw", "|")
        text = unescaped(F.substr("_raw", cut + 1), "\n", "\r")
        return lines.select(F.substring("_raw", F.lit(1), cut - 1).cast("bigint").alias("k"), text.alias("text"))


_charset("src_charset", "ISO-8859-1", {"lineSep": "\n"})
_charset("src_charset_wide", "UTF-16BE", {"lineSep": "\n", "encoding": "UTF-16BE"})


@register("src_record_separator", "SRC-09", "SELECT doc_id AS k, text FROM documents")
def src_record_separator(spark, sf):
    """Records end in '~', so documents keep their line breaks."""
    path = work_path(spark, "sep")
    rows = columns(spark, sf, "documents", {"value": f"CAST(doc_id AS STRING) || '|' || {escaped('text', '~')}"})
    rows.write.option("lineSep", "~").text(path)
    lines = read_lines(spark, path, line_sep="~")
    cut = F.instr("_raw", "|")
    text = unescaped(F.substr("_raw", cut + 1), "~")
    return lines.select(F.substring("_raw", F.lit(1), cut - 1).cast("bigint").alias("k"), text.alias("text"))


CUSTOMER_FIXED = FileSpec("customer-fw", "customer-fw", "FIXED_WIDTH", (
    FieldSpec("id", "LONG", start_position=1, length=12),
    FieldSpec("segment", start_position=13, length=12),
    FieldSpec("balance", "AMOUNT", start_position=25, length=14, scale=2),
    FieldSpec("name", start_position=39, length=30),
), position_base=1)


@register("src_fixed_width", "SRC-10", """SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment,
 CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance, c_name AS name FROM customer""")
def src_fixed_width(spark, sf):
    rows = columns(spark, sf, "customer", {
        "b": "CAST(floor(c_custkey / 4000.0) AS BIGINT)", "k": "c_custkey",
        "value": "lpad(CAST(c_custkey AS STRING), 12, '0') || rpad(c_mktsegment, 12, ' ') || lpad(CAST(CAST(c_acctbal * 100 AS DECIMAL(18,0)) AS STRING), 14, ' ') || rpad(c_name, 30, ' ')"})
    parsed = read_records(spark, write_files(rows, work_path(spark, "fixed"), ["b"]), CUSTOMER_FIXED)
    return parsed.select(F.col("f_id").cast("bigint").alias("k"), *[F.col(f"f_{n}").alias(n) for n in ("id", "segment", "balance", "name")])


SUPPLIER_XML = load_spec({
    "id": "supplier-xml", "format": "XML", "metadata": {"recordXPath": "/suppliers/supplier"}, "fields": [
        {"name": "id", "type": "LONG", "xmlAttribute": "key"},
        {"name": "name", "path": "info/name"},
        {"name": "balance", "path": "info/balance"},
        {"name": "currency", "path": "info/balance/@ccy"},
        {"name": "phone", "path": "info/phone", "required": False, "defaultValue": "none"}]})
SUPPLIER_ELEMENT = (
    "'<supplier key=\"' || CAST(s_suppkey AS STRING) || '\"><info><name>' || s_name || ' &amp; Co</name><balance ccy=\"EUR\">' || "
    "CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING) || '</balance>' || CASE WHEN s_acctbal < 0 THEN '' ELSE '<phone> 1' || CAST(s_nationkey AS STRING) || '</phone><phone>x</phone>' END || '</info></supplier>'"
)
SUPPLIER_SQL = """s_suppkey AS k, s_name || ' & Co' AS name, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance, 'EUR' AS currency,
 CASE WHEN s_acctbal < 0 THEN 'none' ELSE ' 1' || CAST(s_nationkey AS VARCHAR) END AS phone"""


def _supplier_columns(records):
    return records.select(F.col("f_id").cast("bigint").alias("k"), *[F.col(f"f_{n}").alias(n) for n in ("name", "balance", "currency", "phone")], "_seq")


@register("src_xml", "SRC-11, SRC-13", f"SELECT {SUPPLIER_SQL}, row_number() OVER (PARTITION BY floor(s_suppkey / 40.0) ORDER BY s_suppkey) - 1 AS seq FROM supplier")
def src_xml(spark, sf):
    """Documents written as files, cut into record chunks and parsed once per record."""
    rows = columns(spark, sf, "supplier", {"b": "CAST(floor(s_suppkey / 40.0) AS BIGINT)", "k": "s_suppkey", "value": SUPPLIER_ELEMENT})
    path = write_files(_enclosed(rows, '<?xml version="1.0"?><suppliers>', "</suppliers>"), work_path(spark, "xml"), ["b"])
    return _supplier_columns(read_records(spark, path, SUPPLIER_XML)).withColumnRenamed("_seq", "seq")


def _enclosed(rows, first, last):
    """Adds a first and a last line to every file; columns: the keys of a file, k, value."""
    keys = [c for c in rows.columns if c not in ("k", "value")]
    ends = F.array(
        F.struct(F.lit(-1).cast("bigint").alias("k"), F.lit(first).alias("value")),
        F.struct(F.lit(2**62).alias("k"), F.lit(last).alias("value")))
    return rows.select(*keys, "k", "value").unionByName(rows.select(*keys).distinct().select(*keys, F.inline(ends)))


def _part():
    return F.regexp_extract("_file", "/part=([0-9]+)/", 1).cast("bigint").alias("_part")


def _counted_on(done, label, of, figures):
    """Numbers of records that count on over the parts of a series: per figure what the earlier parts have in all.

    ``figures`` give what a file adds, by an aggregate over its records. Adds the sums as ``_before_<figure>``.
    """
    done = stored(done, label)
    sizes = done.groupBy(of, "_part").agg(*[figure.alias(n) for n, figure in figures.items()])
    earlier = W.partitionBy(of).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(of, "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in figures])
    return done.join(F.broadcast(before), [of, "_part"])


def _supplier_records(spark, sf):
    rows = columns(spark, sf, "supplier", {"k": "s_suppkey", "x": SUPPLIER_ELEMENT})
    return rows.select(F.lit(None).cast("string").alias("_file"), F.col("k").alias("_seq"), F.col("x").alias("_xml"))


@register("src_xml_xpath", "SRC-12", f"SELECT {SUPPLIER_SQL}, CAST(length(s_name || ' & Co') AS VARCHAR) AS name_length FROM supplier")
def src_xml_xpath(spark, sf):
    """Plain paths share one parse; the XPath function goes through the XPath engine."""
    raw = {"id": "x", "format": "XML", "metadata": dict(SUPPLIER_XML.metadata), "fields": [
        {"name": "id", "xmlAttribute": "key"}, {"name": "name", "path": "info/name"}, {"name": "balance", "path": "/suppliers/supplier/info/balance"},
        {"name": "currency", "path": "info/balance/@ccy"}, {"name": "phone", "path": "info/phone", "required": False, "defaultValue": "none"},
        {"name": "chars", "path": "info[string-length(name) > 0]/name"}]}
    done = parse_xml_text(_supplier_records(spark, sf), load_spec(raw))
    return _supplier_columns(done.withColumn("_seq", F.length("f_chars").cast("string"))).withColumnRenamed("_seq", "name_length")


@register("src_xml_attr", "SRC-13", "SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS key FROM supplier")
def src_xml_attr(spark, sf):
    done = parse_xml_text(_supplier_records(spark, sf), SUPPLIER_XML)
    return done.select(F.col("_seq").alias("k"), F.col("f_id").alias("key"))


# Fixed value: the schema language's name.
XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="supplier"><xs:complexType><xs:sequence>
 <xs:element name="balance"><xs:simpleType><xs:restriction base="xs:decimal"><xs:minInclusive value="0"/></xs:restriction></xs:simpleType></xs:element>
</xs:sequence><xs:attribute name="key" type="xs:int" use="required"/></xs:complexType></xs:element></xs:schema>"""


@register("src_xml_schema", "SRC-15", """SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN 'Record does not match the schema' END AS message FROM supplier""")
def src_xml_schema(spark, sf):
    """Each record checked against a schema file; those that break it are told and, as nothing in them can be trusted, empty."""
    home = work_path(spark, "schema")
    Files(spark, home).create(f"{home}/supplier.xsd", XSD)
    rows = columns(spark, sf, "supplier", {"b": "CAST(floor(s_suppkey / 400.0) AS BIGINT)", "k": "s_suppkey", "value":
        "'<supplier key=\"' || CAST(s_suppkey AS STRING) || '\"><balance>' || CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING) || '</balance></supplier>'"})
    path = write_files(_enclosed(rows, "<suppliers>", "</suppliers>"), work_path(spark, "schema-xml"), ["b"])
    spec = load_spec({"id": "x", "format": "XML", "metadata": {"recordXPath": "/suppliers/supplier", "xsdLocation": f"{home}/supplier.xsd"}, "fields": [
        {"name": "balance", "path": "balance", "required": False}]})
    done = read_records(spark, path, spec)
    # records of a file are its suppliers in order, whose keys are numbered from 0
    first = F.regexp_extract("_file", "/b=([0-9]+)/", 1).cast("bigint") * 400
    return done.select((first + F.col("_seq")).alias("k"), F.get("_errors", F.lit(0))["message"].alias("message"))


@register("xml_required", "PRJ-15", """SELECT s_suppkey AS k, 'Required XML field ''phone'' not found at path ''info/phone''' AS message FROM supplier WHERE s_acctbal < 0""")
def xml_required(spark, sf):
    spec = load_spec({"id": "x", "format": "XML", "metadata": dict(SUPPLIER_XML.metadata), "fields": [{"name": "phone", "path": "info/phone", "nullable": True}]})
    done = parse_xml_text(_supplier_records(spark, sf), spec)
    return done.select(F.col("_seq").alias("k"), F.explode("_errors").alias("e")).select("k", "e.message")


# Element names of the ISO 20022 payment message.
MESSAGE, PAYMENT = "/Document/CstmrCdtTrfInitn", "/Document/CstmrCdtTrfInitn/PmtInf"
TRANSFER = load_spec({
    "id": "transfer", "format": "ISO20022", "metadata": {"recordXPath": f"{PAYMENT}/CdtTrfTxInf"}, "fields": [
        {"name": "wanted", "type": "DECIMAL", "path": "Amt/InstdAmt"},
        {"name": "money", "path": "Amt/InstdAmt/@Ccy"},
        {"name": "chain", "path": f"{PAYMENT}/CdtTrfTxInf/PmtId/EndToEndId"},
        {"name": "block", "path": f"{PAYMENT}/PmtInfId"},
        {"name": "payer", "path": f"{PAYMENT}/Dbtr/Nm"},
        {"name": "day", "type": "DATE", "path": f"{PAYMENT}/ReqdExctnDt"},
        {"name": "message", "path": f"{MESSAGE}/GrpHdr/MsgId"},
        {"name": "count", "type": "INTEGER", "path": f"{MESSAGE}/GrpHdr/NbOfTxs"}]})


def write_transfers(spark, sf):
    """One message per span of order keys, with a payment block per priority and a transfer per order."""
    rows = columns(spark, sf, "orders", {
        "b": FILE_OF, "p": "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)", "o": "o_orderkey",
        "value": f"'<CdtTrfTxInf><PmtId><EndToEndId>E' || CAST(o_orderkey AS STRING) || '</EndToEndId></PmtId><Amt><InstdAmt Ccy=\"EUR\">' || {PRICE} || '</InstdAmt></Amt></CdtTrfTxInf>'"})
    k = F.col("p") * F.lit(1 << 50)
    body = rows.select("b", (k + F.col("o") + 1).alias("k"), "value")
    block = rows.select("b", "p").distinct()
    # the last block names no day of its own
    opened = F.format_string("<PmtInf><PmtInfId>P%s</PmtInfId>%s<Dbtr><Nm>payer %s of %s</Nm></Dbtr>", F.col("p").cast("string"),
                             F.when(F.col("p") < 5, F.format_string("<ReqdExctnDt>2026-01-0%s</ReqdExctnDt>", F.col("p").cast("string"))).otherwise(""),
                             F.col("p").cast("string"), F.col("b").cast("string"))
    ends = block.select("b", F.inline(F.array(
        F.struct(k.alias("k"), opened.alias("value")), F.struct((k + F.lit(1 << 49)).alias("k"), F.lit("</PmtInf>").alias("value")))))
    heads = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.lit(-1).cast("bigint").alias("k"), F.format_string(
        '<?xml version="1.0"?><Document><CstmrCdtTrfInitn><GrpHdr><MsgId>M-%s</MsgId><NbOfTxs>%d</NbOfTxs></GrpHdr>', F.col("b").cast("string"), "n").alias("value"))
    tails = heads.select("b", F.lit(2**62).alias("k"), F.lit("</CstmrCdtTrfInitn></Document>").alias("value"))
    return write_files(body.unionByName(ends).unionByName(heads).unionByName(tails), work_path(spark, "transfers"), ["b"])


TRANSFER_SQL = f"""SELECT 'M-' || CAST({FILE_OF} AS VARCHAR) AS message, CAST(count(*) OVER (PARTITION BY {FILE_OF}) AS VARCHAR) AS n,
 'P' || substr(o_orderpriority, 1, 1) AS block, 'payer ' || substr(o_orderpriority, 1, 1) || ' of ' || CAST({FILE_OF} AS VARCHAR) AS payer,
 CASE WHEN o_orderpriority < '5' THEN '2026-01-0' || substr(o_orderpriority, 1, 1) END AS day,
 'E' || CAST(o_orderkey AS VARCHAR) AS chain, {PRICE} AS wanted, 'EUR' AS money,
 row_number() OVER (PARTITION BY {FILE_OF} ORDER BY substr(o_orderpriority, 1, 1), o_orderkey) - 1 AS seq FROM orders"""


@register("src_xml_header_join", "SRC-14, JOI-12", TRANSFER_SQL)
def src_xml_header_join(spark, sf):
    """Leaf and nested headers, of the message and of the block that each transfer stands in."""
    records = read_records(spark, write_transfers(spark, sf), TRANSFER)
    return records.select(F.col("f_message").alias("message"), F.col("f_count").alias("n"), *[
        F.col(f"f_{c}").alias(c) for c in ("block", "payer", "day", "chain", "wanted", "money")], F.col("_seq").alias("seq"))


@register("src_iso20022", "SRC-16", f"""SELECT 'M-' || CAST({FILE_OF} AS VARCHAR) AS message, 'P' || substr(o_orderpriority, 1, 1) AS block, count(*) AS n,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM orders GROUP BY 1, 2""")
def src_iso20022(spark, sf):
    records = read_records(spark, write_transfers(spark, sf), TRANSFER)
    return records.groupBy(F.col("f_message").alias("message"), F.col("f_block").alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("f_wanted").cast("decimal(18,2)")).cast("string").alias("total"))


BRANCH_XML = load_spec({"id": "branch", "format": "XML", "metadata": {"recordXPath": "/all/good/row", "emptyRecords": "true"}, "fields": [
    {"name": "id", "type": "LONG", "xmlAttribute": "id"}, {"name": "name", "xmlAttribute": "name"}]})


@register("src_xml_branch", "SRC-11, SRC-13", "SELECT c_custkey AS k, c_name AS name, row_number() OVER (ORDER BY c_custkey) - 1 AS seq FROM customer WHERE c_acctbal >= 0")
def src_xml_branch(spark, sf):
    """Empty elements, split over tasks, of which only those under the spec's own branch are records."""
    rows = columns(spark, sf, "customer", {
        "b": "0L", "k": "c_custkey",
        "value": "CASE WHEN c_acctbal < 0 THEN '<bad><row id=\"' ELSE '<good><row id=\"' END || CAST(c_custkey AS STRING) || '\" name=\"' || c_name || '\"/>' || CASE WHEN c_acctbal < 0 THEN '</bad>' ELSE '</good>' END"})
    path = write_files(_enclosed(rows, "<all>", "</all>"), work_path(spark, "branch"), ["b"])
    done = read_records(spark, path, BRANCH_XML)
    return done.select(F.col("f_id").cast("bigint").alias("k"), F.col("f_name").alias("name"), F.col("_seq").alias("seq"))


DOC_XML = load_spec({"id": "documents-xml", "format": "XML", "metadata": {"recordXPath": "/all/doc"}, "fields": [
    {"name": "id", "type": "LONG", "xmlAttribute": "id"}, {"name": "said", "xmlAttribute": "said"},
    {"name": "text", "path": "text", "required": False, "nullable": True}, {"name": "title", "path": "/all/head/title"}]})
# XML has no other control characters than these three, and no carriage return that survives
PLAIN_TEXT = r"regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '?'{})"


def _doc_xml(name, ids, element, head):
    """Documents in a file per language and span of ids, cut over tasks where their markup allows it."""
    sql = f"""SELECT lang, doc_id AS k, doc_id || ' > ' || source AS said, {PLAIN_TEXT.format(", 'g'")} AS text, 'a > b' AS title,
 row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS seq FROM documents"""

    @register(name, ids, sql)
    def run(spark, sf):
        rows = columns(spark, sf, "documents", {"b": "lang", "part": f"CAST(floor(doc_id / {DOCUMENT_KEYS}.0) AS BIGINT)", "k": "doc_id", "value": element.replace("TEXT", PLAIN_TEXT.format("").replace("\\x", "\\\\x"))})
        path = write_files(_enclosed(rows, head, "</all>"), work_path(spark, name), ["b", "part"])
        done = read_records(spark, path, DOC_XML).select(
            F.regexp_extract("_file", "/b=([a-z]+)/", 1).alias("lang"), _part(), F.col("f_id").cast("bigint").alias("k"), F.col("f_said").alias("said"),
            F.coalesce("f_text", F.lit("")).alias("text"), F.col("f_title").alias("title"), "_seq")
        done = _counted_on(done, name, "lang", {"records": F.count(F.lit(1))})
        return done.select("lang", "k", "said", "text", "title", (F.col("_before_records") + F.col("_seq")).alias("seq"))


_doc_xml(
    "src_xml_attr_text", "SRC-11, SRC-13, SRC-14",
    "'<doc id=\"' || CAST(doc_id AS STRING) || '\" said=\"' || CAST(doc_id AS STRING) || ' > ' || source || '\"><note mark=\"/>\"/><text>' || replace(replace(TEXT, '&', '&amp;'), '<', '&lt;') || '</text></doc>'",
    "<all><head mark='a > \"b\"/>'><title>a > b</title></head>")
_doc_xml(
    "src_xml_cdata", "SRC-11, SRC-12",
    "'<!-- <doc id=\"0\"> </doc> --><doc id=\"' || CAST(doc_id AS STRING) || '\" said=\"' || CAST(doc_id AS STRING) || ' > ' || source || '\"><skip><![CDATA[</doc><doc><!-- ]]></skip><text><![CDATA[' || TEXT || ']]></text><!-- </doc> --></doc>'",
    "<?xml version=\"1.0\"?><all><!-- <doc></doc> --><head><title><![CDATA[a > b]]></title></head>")


EVENT_JSON = load_spec({"id": "event-json", "format": "JSON", "fields": [
    {"name": "id", "type": "LONG", "path": "$.id"}, {"name": "k", "type": "INTEGER", "path": "$.body.props.k"},
    {"name": "kind", "path": "$.body.kind"}, {"name": "first", "path": "$.tags[0]"}]})


@register("src_json", "SRC-17", """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS kind, 't' || CAST(user_id AS VARCHAR) AS first FROM events""")
def src_json(spark, sf):
    rows = columns(spark, sf, "events", {"b": "CAST(floor(event_id / 4000.0) AS BIGINT)", "k": "event_id", "value": """'{"id":' || CAST(event_id AS STRING) || ',"body":{"kind":"' || event_type || '","props":' || props || '},"tags":["t' || CAST(user_id AS STRING) || '","z"]}'"""})
    parsed = read_records(spark, write_files(rows, work_path(spark, "json"), ["b"]), EVENT_JSON)
    return parsed.select(F.col("f_id").cast("bigint").alias("id"), F.col("f_k").alias("k"), F.col("f_kind").alias("kind"), F.col("f_first").alias("first"))


@register("src_json_document", "SRC-17", """SELECT event_type AS kind, event_id AS id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, '}, {"' || event_id || '" ]' AS text, false AS bad FROM events
 UNION ALL SELECT DISTINCT event_type, CAST(NULL AS BIGINT), NULL, NULL, true FROM events""")
def src_json_document(spark, sf):
    """All events as arrays over many lines, a file per kind and span of ids, split over tasks; each array begins with an element that is no record."""
    said = "'}, {\\\\\"' || CAST(event_id AS STRING) || '\\\\\" ]'"
    rows = columns(spark, sf, "events", {"b": "event_type", "part": f"CAST(floor(event_id / {EVENT_KEYS}.0) AS BIGINT)", "k": "event_id", "value": f"""',\n {{"id": ' || CAST(event_id AS STRING) || ',\n  "body": {{"props": ' || props || ',\n "text": "' || {said} || '"}}\n }}'"""})
    path = write_files(_enclosed(rows, '["}", 7', "]"), work_path(spark, "json-document"), ["b", "part"])
    spec = load_spec({"id": "event-document", "format": "JSON", "fields": [
        {"name": "id", "type": "LONG", "path": "$.id"}, {"name": "k", "type": "INTEGER", "path": "$.body.props.k"}, {"name": "text", "path": "$.body.text"}]})
    done = read_records(spark, path, spec).select(
        F.regexp_extract("_file", "/b=([a-z_]+)/", 1).alias("kind"), F.col("f_id").cast("bigint").alias("id"), F.col("f_k").alias("k"), F.col("f_text").alias("text"),
        (F.size("_errors") > 0).alias("bad"))
    # the bad elements of a kind are alike
    return done.filter("not bad").unionByName(done.filter("bad").distinct())


def nacha_text(spark, sf):
    """Orders as bank entries: one batch header per day, entries after it."""
    rows = columns(spark, sf, "orders", {
        "day": DAY, "k": "o_orderkey",
        "line": "'6' || '22' || '091000019' || rpad('AC' || CAST(o_custkey AS STRING), 17, ' ') || lpad(replace(" + PRICE + ", '.', ''), 10, '0') || rpad(CAST(o_orderkey AS STRING), 15, ' ') || rpad(o_orderpriority, 22, ' ') || '  0' || '09100001' || lpad(CAST(o_orderkey AS STRING), 7, '0')"})
    heads = rows.select("day").distinct().select("day", F.lit(-1).cast("bigint").alias("k"), F.concat(F.lit("5200"), "day").alias("line"))
    whole = rows.unionByName(heads)
    return whole.select(F.lit("nacha.txt").alias("_file"), F.concat_ws("/", "day", F.lpad((F.col("k") + 1).cast("string"), 20, "0")).alias("_seq"), F.col("line").alias("_raw"))


@register("src_nacha", "SRC-18", f"""SELECT o_orderkey AS k, 'AC' || CAST(o_custkey AS VARCHAR) AS account, {PRICE} AS amount,
 dense_rank() OVER (ORDER BY {DAY}) AS batch_no, o_orderpriority AS name, '09100001' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS trace FROM orders""")
def src_nacha(spark, sf):
    done = nacha_entries(nacha_text(spark, sf))
    return done.select(F.col("f_individualId").cast("bigint").alias("k"), F.col("f_account").alias("account"), F.col("f_amount").alias("amount"),
                       F.col("_batch").alias("batch_no"), F.col("f_individualName").alias("name"), F.col("f_trace").alias("trace"))


@register("envelope_id", "WIN-08", f"""SELECT batch_no, record_type, count(*) AS n FROM (
 SELECT dense_rank() OVER (ORDER BY {DAY}) AS batch_no, 'ENTRY' AS record_type FROM orders
 UNION ALL SELECT row_number() OVER (ORDER BY d), 'BATCH_HEADER' FROM (SELECT DISTINCT {DAY} AS d FROM orders)) GROUP BY ALL""")
def envelope_id(spark, sf):
    lines = nacha_lines(nacha_text(spark, sf))
    return lines.groupBy(F.col("_batch").alias("batch_no"), "record_type").agg(F.count(F.lit(1)).alias("n"))


SWIFT = load_spec({"id": "mt", "format": "SWIFT_MT", "fields": [
    {"name": "reference", "path": "20"}, {"name": "value", "path": "32A"}, {"name": "details", "path": "70"}, {"name": "charges", "path": "71A", "required": False, "nullable": True}]})
MT_TEXT = (
    f"'{{1:F01BANK}}{{4:' || chr(10) || ':20:REF' || CAST(o_orderkey AS STRING) || chr(10) || ':32A:' || replace(substr({DAY}, 3), '-', '') || 'EUR' || replace({PRICE}, '.', ',') "
    "|| chr(10) || ':70:' || o_orderpriority || chr(10) || 'second line' || CASE WHEN o_orderstatus = 'F' THEN chr(10) || ':71A:SHA' ELSE '' END || chr(10) || '-}'"
)


@register("src_swift_mt", "SRC-19", f"""SELECT o_orderkey AS k, 'REF' || CAST(o_orderkey AS VARCHAR) AS reference,
 replace(substr({DAY}, 3), '-', '') || 'EUR' || replace({PRICE}, '.', ',') AS value, o_orderpriority || chr(10) || 'second line' AS details,
 CASE WHEN o_orderstatus = 'F' THEN 'SHA' END AS charges, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END AS n_tags FROM orders""")
def src_swift_mt(spark, sf):
    rows = columns(spark, sf, "orders", {"b": FILE_OF, "k": "o_orderkey", "value": MT_TEXT})
    done = read_records(spark, write_files(rows, work_path(spark, "mt"), ["b"]), SWIFT)
    return done.select(F.substring("f_reference", 4, 30).cast("bigint").alias("k"), *[F.col(f"f_{n}").alias(n) for n in ("reference", "value", "details", "charges")],
                       F.size(swift_tags(F.col("_raw"))).alias("n_tags"))


# Fixed value: an interchange header of the public layout, with its separators left open.
ISA_HEADER = "ISA{0}00{0}          {0}00{0}          {0}ZZ{0}EAST SENDER    {0}ZZ{0}RECEIVER       {0}260101{0}0600{0}U{0}00401{0}000000001{0}0{0}P{0}>"
DIALECTS = {"A": ("*", "~"), "N": ("|", "\n"), "R": ("*", "'")}
X12_SPEC = load_spec({"id": "remittance", "format": "EDI_X12", "metadata": {"recordSegment": "RMR"}, "fields": [
    {"name": "items", "type": "INTEGER", "path": "1"}, {"name": "quantity", "type": "INTEGER", "path": "2"},
    {"name": "transaction", "path": "transaction"}, {"name": "interchange", "path": "interchange"}]})


def write_x12(spark, sf):
    """Line items as X12 files, per return flag (each in a dialect of its own) and span of orders: ISA, then ST and the items of an order, SE."""
    path = work_path(spark, "x12")
    items = columns(spark, sf, "lineitem", {
        "f": "l_returnflag", "part": f"coalesce(CAST(floor(l_orderkey / {TRANSACTION_KEYS}.0) AS BIGINT), 0)", "o": "l_orderkey", "q": "CAST(l_quantity AS BIGINT)"})
    rows = stored(items.groupBy("f", "part", "o").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q")), "x12-orders")
    for flag, (element, segment) in DIALECTS.items():
        said = F.concat_ws(segment, F.concat_ws(element, F.lit("ST"), F.lit("820"), "o"), F.concat_ws(element, F.lit("RMR"), "n", "q"),
                           F.concat_ws(element, F.lit("SE"), F.lit("2"), "o"))
        body = rows.filter(F.col("f") == flag).select("f", "part", F.col("o").alias("k"), said.alias("value"))
        # a flag without orders has a file as well
        files = body.select("f", "part").unionByName(spark.range(1).select(F.lit(flag).alias("f"), F.lit(0).cast("bigint").alias("part"))).distinct()
        head = files.select("f", "part", F.lit(-1).cast("bigint").alias("k"), F.lit(ISA_HEADER.format(element)).alias("value"))
        placed = body.unionByName(head).repartition("f", "part").sortWithinPartitions("f", "part", "k")
        placed.select("f", "part", "value").write.mode("append").partitionBy("f", "part").option("lineSep", segment).text(path)
    return path


@register("src_edi_x12", "SRC-20", """SELECT f AS file, CAST(dense_rank() OVER (PARTITION BY f ORDER BY o) AS VARCHAR) AS transaction_no, '1' AS interchange_no,
 CAST(n AS VARCHAR) AS n_items, CAST(q AS VARCHAR) AS quantity, row_number() OVER (PARTITION BY f ORDER BY o) - 1 AS rank FROM (
 SELECT l_returnflag AS f, l_orderkey AS o, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL)""")
def src_edi_x12(spark, sf):
    """Files of three partners in one folder, each cut by the separators that its own header names."""
    # segment numbers run over all segments of a file: a header, then three a transaction
    done = read_records(spark, write_x12(spark, sf), X12_SPEC).select(
        F.regexp_extract("_file", "/f=([A-Z])/", 1).alias("file"), _part(), F.col("f_transaction").cast("bigint").alias("_no"), F.col("f_interchange").alias("interchange_no"),
        F.col("f_items").alias("n_items"), F.col("f_quantity").alias("quantity"), F.call_function("div", F.col("_seq") - 2, F.lit(3)).alias("_rank"))
    done = _counted_on(done, "x12-records", "file", {"transactions": F.max("_no"), "records": F.max("_rank") + 1})
    return done.select(
        "file", (F.col("_before_transactions") + F.col("_no")).cast("string").alias("transaction_no"), "interchange_no", "n_items", "quantity",
        (F.col("_before_records") + F.col("_rank")).alias("rank"))


@register("src_parquet", "SRC-21", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def src_parquet(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@register("src_custom", "SRC-22, SRC-23, EXT-01", "SELECT conv_id, turn, role, CAST(length(text) AS VARCHAR) AS chars FROM conversations")
def src_custom(spark, sf):
    """A reader registered by the user for the open format."""
    from specflow.operators.records import from_columns

    def reader(session, paths, spec, glob):
        frame = session.read.parquet(*paths).withColumn("chars", F.length("text"))
        return from_columns(frame, spec, seq="conv_id")

    register_reader("CUSTOM", reader)
    spec = FileSpec("chat", "chat", "CUSTOM", (FieldSpec("turn", "LONG"), FieldSpec("role"), FieldSpec("chars", "INTEGER")))
    done = read_records(spark, f"{sf}/conversations.parquet", spec)
    return done.select(F.col("_seq").alias("conv_id"), F.col("f_turn").cast("bigint").alias("turn"), F.col("f_role").alias("role"), F.col("f_chars").alias("chars"))


@register("src_multi_dir", "SRC-24", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def src_multi_dir(spark, sf):
    path = _write_orders(spark, sf, "dirs")
    records = read_records(spark, [f"{path}/s={s}" for s in ("F", "O", "P")], ORDER_CSV)
    return records.groupBy(F.col("f_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("src_glob_filter", "SRC-25", """SELECT url_kind, count(*) AS n FROM (SELECT CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'plain' END AS url_kind, url FROM pages)
 WHERE url LIKE 'https://m.%' OR url LIKE '%#top' OR url LIKE 'http://th%' GROUP BY 1""")
def src_glob_filter(spark, sf):
    """Names chosen by wildcard patterns; a bare name is a prefix."""
    pages = table(spark, sf, "pages")
    kept = pages.filter(matches(F.col("url"), ["https://m.*, *#top", " http://th"]))
    kind = F.when(F.startswith("url", F.lit("https")), "secure").otherwise("plain")
    return kept.groupBy(kind.alias("url_kind")).agg(F.count(F.lit(1)).alias("n"))


@register("src_glob_files", "SRC-25, SRC-24", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def src_glob_files(spark, sf):
    """The same choice made by the file listing, before anything is read."""
    path = work_path(spark, "glob")
    rows = table(spark, sf, "orders").selectExpr("o_orderstatus AS s", "o_orderstatus || ',' || CAST(o_orderkey AS STRING) AS value")
    for status, name in (("F", "daily_f"), ("O", "other_o"), ("P", "partial_p")):
        rows.filter(F.col("s") == status).select("value").write.option("compression", "none").text(f"{path}/{name}")
    spec = FileSpec("g", "g", "CSV", (FieldSpec("status", column_index=0),))
    done = read_records(spark, f"{path}/[dp]a*", spec, filters=["part-*, none"])
    return done.groupBy(F.col("f_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("norm_filters", "SRC-26", """SELECT doc_id AS k, trim(part, ' ') AS word FROM (SELECT doc_id, unnest(string_split(text, ',')) AS part FROM documents) WHERE trim(part, ' ') <> ''""")
def norm_filters(spark, sf):
    """Comma lists to trimmed entries, blanks dropped; run over whole documents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.explode(normalise_filter_column(F.col("text"))).alias("word"))


@register("src_poll_unprocessed", "SRC-31", "SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderstatus <> 'F'")
def src_poll_unprocessed(spark, sf):
    """A table polled for rows its processed-mark table lacks."""
    orders = table(spark, sf, "orders")
    marks = orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    return orders.join(marks, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))


@register("file_meta", "PRJ-29", "SELECT o_orderstatus AS status, count(*) AS n, true AS named, true AS sized FROM orders GROUP BY 1")
def file_meta(spark, sf):
    path = _write_orders(spark, sf, "meta", header=False)
    lines = spark.read.text(path).select("s", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return lines.groupBy(F.col("s").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.endswith("path", F.col("name"))).alias("named"), F.min(F.col("size") > 0).alias("sized"))


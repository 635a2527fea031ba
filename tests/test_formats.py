import pytest
from pyspark.sql import functions as F

from specflow.sources import read_records, register_reader
from specflow.sources.fixed_width import parse_fixed_width
from specflow.sources.json_records import parse_json_lines
from specflow.sources.lines import read_lines
from specflow.sources.listing import file_facts, glob_of, matches, normalise_filters
from specflow.sources.payments import nacha_entries, nacha_lines, x12_segments
from specflow.spec import FieldSpec, FileSpec, load_spec


def put(folder, name, text, encoding="utf-8"):
    with open(f"{folder}/{name}", "w", encoding=encoding) as out:
        out.write(text)


FIXED = FileSpec("f", "f", "FIXED_WIDTH", (
    FieldSpec("code", start_position=0, length=2), FieldSpec("amount", "AMOUNT", start_position=2, length=6, scale=2),
    FieldSpec("flag", "BOOLEAN", start_position=8, length=4), FieldSpec("tail", start_position=12, length=4)))


def test_fixed_width(lines):
    good, short, bad = parse_fixed_width(lines("AB001234true tail", "AB000001Y   ", "ABxxxxxxTRUEzz"), FIXED).orderBy("_seq").collect()
    assert (good.f_code, good.f_amount, good.f_flag, good.f_tail) == ("AB", "12.34", "true", "tai")
    assert short.f_tail is None and short._errors[0].message == "Line too short to extract field 'tail' at position 12"
    assert short.f_flag == "true" and bad.f_flag == "false"
    assert bad.f_amount == "xxxxxx" and bad._errors[0].message == "Type conversion failed for 'amount': 'xxxxxx' is not AMOUNT"


def test_fixed_width_positions_from_one(lines):
    spec = FileSpec("f", "f", "FIXED_WIDTH", (FieldSpec("a", start_position=1, length=2), FieldSpec("b", start_position=3, length=9, required=True)), position_base=1)
    row = parse_fixed_width(lines("xy   "), spec).first()
    assert row.f_a == "xy" and row._errors[0].message == "Required field 'b' is blank"


def test_fixed_width_file_with_header(spark, folder):
    put(folder, "a.txt", "HEADER\n\nAB000100Y   tail\nCD000200N   tail\n")
    spec = FileSpec("f", "f", "FIXED_WIDTH", FIXED.fields, has_header=True)
    assert [(r._seq, r.f_code) for r in read_records(spark, folder, spec).orderBy("_seq").collect()] == [(0, "AB"), (1, "CD")]


@pytest.mark.parametrize("scale, text, shown", [(0, "12", "12"), (3, "5", "0.005"), (2, "-150", "-1.50")])
def test_implied_decimals(lines, scale, text, shown):
    spec = FileSpec("f", "f", "FIXED_WIDTH", (FieldSpec("a", "AMOUNT", start_position=0, length=10, scale=scale),))
    assert parse_fixed_width(lines(text), spec).first().f_a == shown


XML = load_spec({"id": "x", "format": "XML", "metadata": {"recordXPath": "/doc/list/item"}, "fields": [
    {"name": "key", "xmlAttribute": "k"}, {"name": "name", "path": "a/name"}, {"name": "unit", "path": "a/size/@unit", "required": False},
    {"name": "title", "path": "/doc/head/title"}, {"name": "count", "path": "count(/item/a/name)"}]})


def test_xml_file(spark, folder):
    body = "".join(f'<item k="{i}">\n <a><name>n{i}</name><name>second</name><size unit="cm">3</size></a></item>\n' for i in range(300))
    put(folder, "a.xml", f'<?xml version="1.0"?><doc><head><title>T &lt;1&gt;</title></head><list>{body}<item k="last"/><itemised/></list></doc>')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = read_records(spark, folder, XML).orderBy("_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 301 and [r._seq for r in rows] == list(range(301))
    first, last = rows[0], rows[-1]
    assert (first.f_key, first.f_name, first.f_unit, first.f_title, first.f_count) == ("0", "n0", "cm", "T <1>", "2")
    assert last.f_key == "last" and [e.field for e in last._errors] == ["name"]
    assert last._errors[0].message == "Required XML field 'name' not found at path 'a/name'"


def test_json_lines(lines):
    spec = load_spec({"id": "j", "format": "JSON", "fields": [
        {"name": "a", "type": "INTEGER", "path": "$.x.a"}, {"name": "x", "path": "$.x"}, {"name": "b", "path": "$.list[1]"}, {"name": "c", "required": False}]})
    row = parse_json_lines(lines('{"x":{"a":7},"list":[1,"two"],"c":null}'), spec).first()
    assert (row.f_a, row.f_b, row.f_c) == ("7", "two", None) and '"a":7' in row.f_x
    assert {e.field for e in parse_json_lines(lines("not json"), spec).first()._errors} == {"a", "x", "b"}


def entry(account, amount, name):
    return "6" + "22" + "091000019" + account.ljust(17) + str(amount).rjust(10, "0") + "ID".ljust(15) + name.ljust(22) + "  0" + "091000010000001"


def test_nacha(lines):
    text = ["101 HEADER", "5200A", entry("A1", 1250, "ANN"), entry("A2", 5, "BOB"), "5200B", entry("A3", 7, "CY"), "8", "9"]
    frame = lines(*text)
    assert [(r._batch, r.record_type) for r in nacha_lines(frame).orderBy("_seq").collect()] == [
        (0, "FILE_HEADER"), (1, "BATCH_HEADER"), (1, "ENTRY"), (1, "ENTRY"), (2, "BATCH_HEADER"), (2, "ENTRY"), (2, "BATCH_CONTROL"), (2, "FILE_CONTROL")]
    rows = nacha_entries(frame).orderBy("_seq").collect()
    assert {len(r._raw) for r in rows} == {94} and {r.f_routing for r in rows} == {"091000019"} and {r.f_code for r in rows} == {"22"}
    assert [(r.f_account, r.f_amount, r.f_individualName, r._batch) for r in rows] == [("A1", "12.50", "ANN", 1), ("A2", "0.05", "BOB", 1), ("A3", "0.07", "CY", 2)]


def test_swift(spark, folder):
    put(folder, "a.mt", "{1:F01}{4:\n:20:R1\n:70:two\nlines\n-}\n{1:F01}{4:\n:20:R2\n-}\n")
    spec = load_spec({"id": "s", "format": "SWIFT_MT", "fields": [{"name": "ref", "path": "20"}, {"name": "text", "path": "70"}]})
    rows = read_records(spark, folder, spec).orderBy("_seq").collect()
    assert [(r.f_ref, r.f_text, len(r._errors)) for r in rows] == [("R1", "two\nlines", 0), ("R2", None, 1)]


def test_x12_from_a_file(spark, folder):
    put(folder, "a.edi", "ISA*00*S~\nGS*RA~\nST*820*1~\nRMR*1*~\nSE*2~\nST*820*2~\nSE*1~\nGE~IEA~\n")
    from specflow.sources.lines import number_lines

    data, _ = number_lines(read_lines(spark, folder, line_sep="~"))
    rows = x12_segments(data).orderBy("_seq").collect()
    assert [(r.segment_id, r.transaction_no) for r in rows][2:7] == [("ST", 1), ("RMR", 1), ("SE", 1), ("ST", 2), ("SE", 2)]
    assert rows[3].elements == ["1", ""] and rows[-1].interchange_no == 1


ISA = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *260101*0600*U*00401*000000001*0*P*>"


@pytest.mark.parametrize("element, terminator, ending", [("*", "~", ""), ("*", "~", "\n"), ("|", "'", "\r\n"), ("*", "\n", "")])
def test_x12_reader_takes_separators_from_the_header(spark, folder, element, terminator, ending):
    assert len(ISA) == 105
    segments = [ISA, "GS*RA*A*B", "ST*820*1", "RMR*IV*77**5.25", "SE*3*1", "ST*820*2", "RMR*IV*78*x*7", "SE*3*2", "GE*2*1", "IEA*1*1"]
    put(folder, "a.edi", "".join(s.replace("*", element) + terminator + ending for s in segments))
    spec = load_spec({"id": "e", "format": "EDI_X12", "metadata": {"recordSegment": "RMR"}, "fields": [
        {"name": "no", "type": "INTEGER", "path": "2"}, {"name": "note", "path": "3", "required": False, "nullable": True},
        {"name": "paid", "type": "DECIMAL", "path": "4"}, {"name": "batch", "path": "transaction"}]})
    rows = read_records(spark, folder, spec).orderBy("_seq").collect()
    assert [(r.f_no, r.f_note, r.f_paid, r.f_batch) for r in rows] == [("77", None, "5.25", "1"), ("78", "x", "7", "2")]
    assert not any(r._errors for r in rows)


def test_x12_files_of_two_dialects_in_one_folder(spark, folder):
    for name, element, terminator in (("a", "*", "~"), ("b", "|", "\n"), ("c d", "*", "'")):
        segments = [ISA.replace("SENDER ", "EAST ST"), "ST*820*1", f"RMR*IV*{name}", "SE*2*1", "IEA*1*1"]
        put(folder, f"{name}.edi", "".join(s.replace("*", element) + terminator for s in segments))
    put(folder, "e.edi", "no header here")
    spec = load_spec({"id": "e", "format": "EDI_X12", "metadata": {"recordSegment": "RMR"}, "fields": [{"name": "who", "path": "2"}, {"name": "no", "path": "transaction"}]})
    rows = read_records(spark, folder, spec).collect()
    assert sorted((r.f_who or "", r.f_no or "", [e.severity for e in r._errors if e.field == "interchange"]) for r in rows) == [
        ("", "", ["FATAL"]), ("a", "1", []), ("b", "1", []), ("c d", "1", [])]
    assert [r._file[-5:] for r in rows if r._errors] == ["e.edi"]


def test_byte_orders_of_several_files(spark, folder):
    text = "1;Ærø\n2;ਗਊ\n"
    for name, order, mark in (("a", "utf-16-le", b"\xff\xfe"), ("b", "utf-16-be", b"\xfe\xff"), ("c", "utf-16-be", b""), ("d e", "utf-16-le", b"\xff\xfe")):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(mark + text.encode(order))
    spec = load_spec({"id": "c", "format": "DELIMITED", "delimiter": ";", "encoding": "UTF-16", "fields": [{"name": "i", "columnIndex": 0}, {"name": "v", "columnIndex": 1}]})
    rows = read_records(spark, folder, spec).collect()
    assert sorted((r._file.rsplit("/", 1)[1], r._seq, r.f_i, r.f_v) for r in rows) == [
        (n, i, str(i + 1), v) for n in ("a", "b", "c", "d%20e") for i, v in enumerate(("Ærø", "ਗਊ"))]


DOC = load_spec({"id": "d", "format": "XML", "metadata": {"recordXPath": "/doc/a/item"}, "fields": [
    {"name": "v", "path": "v"}, {"name": "own", "path": "/doc/a/label"}, {"name": "who", "path": "/doc/a/by/name"}, {"name": "top", "path": "/doc/title"}]})


def test_xml_paths_blocks_and_other_branches(spark, folder):
    body = "<!-- <a><item><v>no</v> --><title>T</title>"
    for block in range(3):
        items = "".join(f"<item><v>{block}.{i}</v><label>inner</label></item>" for i in range(40))
        label = f"<label>L{block}</label>" if block != 1 else ""
        body += f"<a>{label}<by><name>N{block}</name></by>{items}</a><b><item><v>other</v></item><x><a2/></x></b>"
    put(folder, "a.xml", f"<?xml version='1.0'?><doc>{body}<deep><a><item><v>deeper</v></item></a></deep></doc>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = sorted((r._seq, r.f_v, r.f_own, r.f_who, r.f_top) for r in read_records(spark, folder, DOC).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(b * 40 + i, f"{b}.{i}", f"L{b}" if b != 1 else None, f"N{b}", "T") for b in range(3) for i in range(40)]
    assert rows == want


def test_empty_records_split_over_tasks_and_charsets(spark, folder):
    text = "<all><good>" + "".join(f'<row id="{i}" name="é{i}"/>' for i in range(500)) + '</good><bad><row id="x" name="y"/></bad></all>'
    put(folder, "a.xml", text, "iso-8859-1")
    spec = load_spec({"id": "e", "format": "XML", "encoding": "ISO-8859-1", "metadata": {"recordXPath": "/all/good/row", "emptyRecords": "true"}, "fields": [
        {"name": "id", "xmlAttribute": "id"}, {"name": "name", "xmlAttribute": "name"}]})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        done = read_records(spark, folder, spec)
        assert read_lines(spark, folder, "ISO-8859-1", "/>").rdd.getNumPartitions() > 5
        rows = sorted((r._seq, r.f_id, r.f_name) for r in done.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(i, str(i), f"é{i}") for i in range(500)]


def test_charset(spark, folder):
    put(folder, "a.csv", "1|Zürich\n2|Málaga, \"quoted\"\n", "iso-8859-1")
    spec = load_spec({"id": "c", "format": "DELIMITED", "delimiter": "|", "encoding": "ISO-8859-1", "fields": [{"name": "i", "columnIndex": 0}, {"name": "v", "columnIndex": 1}]})
    assert [r.f_v for r in read_records(spark, folder, spec).orderBy("_seq").collect()] == ["Zürich", "Málaga, quoted"]


def test_filters(spark, folder):
    assert normalise_filters(["SEPA_CREDIT_*, DAILY_REPORT_*", " ", "A,,B"]) == ["SEPA_CREDIT_*", "DAILY_REPORT_*", "A", "B"]
    assert glob_of([]) == "*" and glob_of(["REPORT"]) == "REPORT*" and glob_of(["a*,b.csv"]) == "{a*,b.csv*}"
    names = ["SEPA_CREDIT_1", "DAILY_REPORT_x", "other", "A1"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    hit = [r.n for r in frame.filter(matches(F.col("n"), ["SEPA_CREDIT_*, A"])).collect()]
    assert sorted(hit) == ["A1", "SEPA_CREDIT_1"]
    for n in names:
        put(folder, n, n + "\n")
    spec = FileSpec("g", "g", "CSV", (FieldSpec("v", column_index=0),))
    assert sorted(r.f_v for r in read_records(spark, folder, spec, ["SEPA_CREDIT_*, A"]).collect()) == ["A1", "SEPA_CREDIT_1"]
    facts = {r.remote_file_name: r.file_size_bytes for r in file_facts(spark, folder).collect()}
    assert facts["other"] == 6


def test_own_format(spark):
    from specflow.operators.records import from_columns

    register_reader("CUSTOM", lambda s, paths, spec, glob: from_columns(s.range(3).withColumn("v", F.col("id") * 2), spec, seq="id"))
    rows = read_records(spark, "anywhere", FileSpec("c", "c", "CUSTOM", (FieldSpec("v"),))).collect()
    assert sorted(r.f_v for r in rows) == ["0", "2", "4"]


def test_xml_schema_check(spark, folder):
    put(folder, "s.xsd", '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    put(folder, "d.xml", "<d><r><a>5</a></r><r><a>x</a></r></d>")
    spec = load_spec({"id": "x", "format": "XML", "metadata": {"recordXPath": "/d/r", "xsdLocation": f"{folder}/s.xsd"}, "fields": [{"name": "a", "path": "a", "required": False}]})
    good, bad = read_records(spark, f"{folder}/d.xml", spec).orderBy("_seq").collect()
    assert good.f_a == "5" and not good._errors
    assert [e.message for e in bad._errors] == ["Record does not match the schema"]


def test_documents_come_in_parts_that_count_on(spark, folder, monkeypatch):
    """A series of files is written by as many tasks; numbers of records count on over its parts."""
    import os

    from specflow.catalog import load
    from specflow.catalog import sources as catalog

    monkeypatch.setattr(catalog, "DOCUMENT_KEYS", 4)
    monkeypatch.setattr(catalog, "EVENT_KEYS", 4)
    monkeypatch.setattr(catalog, "TRANSACTION_KEYS", 4)
    written = []
    write = catalog.work_path
    monkeypatch.setattr(catalog, "work_path", lambda session, label: written.append(write(session, label)) or written[-1])
    spark.createDataFrame([(i, f"text {i}", "en" if i % 3 else "de", "s") for i in range(10)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, "view", '{"k": 1}') for i in range(10)], "event_id bigint, event_type string, props string").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(i, "A", 2.0) for i in range(1, 10)], "l_orderkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")

    def run(name):
        return load()[name].run(spark, folder).collect()

    got = sorted((r.lang, r.k, r.seq) for r in run("src_xml_attr_text"))
    assert got == [("de", k, n) for n, k in enumerate((0, 3, 6, 9))] + [("en", k, n) for n, k in enumerate((1, 2, 4, 5, 7, 8))]
    assert sorted(n for n in os.listdir(f"{written[-1]}/b=en")) == ["part=0", "part=1", "part=2"]
    assert sorted((r.id, r.bad) for r in run("src_json_document") if not r.bad) == [(i, False) for i in range(10)]
    assert len(os.listdir(f"{written[-1]}/b=view")) == 3
    assert sorted((int(r.transaction_no), r.rank) for r in run("src_edi_x12")) == [(i + 1, i) for i in range(9)]

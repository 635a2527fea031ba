import glob
import json

import pytest
from pyspark.sql import functions as F

from specflow.operators.mapping import map_fields, register_transform
from specflow.operators.records import from_columns
from specflow.operators.route import passing
from specflow.plans import file_to_file, inbound, outbound
from specflow.sinks import generators, register_sink, write, writers
from specflow.sinks.envelope import envelopes
from specflow.sources import read_records
from specflow.sources.delimited import parse_delimited
from specflow.spec import FieldMapping, FieldSpec, FileSpec, OutputSpec, SpecError, UnsupportedFormatError, load_spec

SPEC = load_spec({"id": "s", "format": "CSV", "fields": [
    {"name": "id", "type": "INTEGER", "columnIndex": 0}, {"name": "amount", "type": "DECIMAL", "columnIndex": 1},
    {"name": "ok", "type": "BOOLEAN", "columnIndex": 2, "required": False}, {"name": "pin", "columnIndex": 3, "required": False, "sensitive": True}],
    "correctionRules": [{"ruleId": "c", "field": "amount", "correctionType": "NUMBER_FORMAT_COERCE"}]})


def test_envelope_types(lines):
    done = inbound.processed(parse_delimited(lines("007,1.50,yes,9", "x,$2,,"), SPEC), SPEC)
    events = [json.loads(r.value) for r in envelopes(passing(done), SPEC, "run", stamp=F.lit(5)).collect()]
    assert events[0]["fields"] == {"id": 7, "amount": 1.5, "ok": True, "pin": "9"}
    assert events[1]["fields"] == {"id": "x", "amount": "2", "ok": None, "pin": None}
    assert events[0]["sequenceNumber"] == 0 and events[0]["eventTimestamp"] == 5 and events[1]["corrected"]


def test_envelope_masks_on_request(lines):
    from dataclasses import replace

    spec = replace(SPEC, mask_sensitive=True)
    done = inbound.processed(parse_delimited(lines("1,1,yes,9"), spec), spec)
    assert json.loads(envelopes(done, spec, "run").first().value)["fields"]["pin"] == "***"


def test_round_trips(spark, folder):
    spec = FileSpec("r", "r", "CSV", (FieldSpec("a", column_index=0), FieldSpec("b", column_index=1, required=False, nullable=True)))
    frame = spark.createDataFrame([(i, f"x, {i}", None if i % 2 else f"y{i}") for i in range(50)], "k int, a string, b string")
    records = from_columns(frame, spec, seq="k")
    cut = generators.split_files(records, (), ("_seq",), 20)
    lines = cut.select(F.col("file_no").alias("file_name"), "line_no", generators.line_of("CSV", ["a", "b"]).alias("line"))
    writers.write_line_files(lines, f"{folder}/out")
    back = read_records(spark, f"{folder}/out", spec).collect()
    assert sorted((r.f_a, r.f_b) for r in back if r.f_b) == sorted((f"x, {i}", f"y{i}") for i in range(0, 50, 2))
    sizes = sorted(sum(1 for _ in open(p)) for p in glob.glob(f"{folder}/out/*/*.txt"))
    assert sizes == [10, 20, 20]
    first = open(glob.glob(f"{folder}/out/file_name=0/*.txt")[0]).read().splitlines()
    assert first[0] == '"x, 0",y0' and first[-1] == '"x, 19",'


def test_fixed_round_trip(spark, lines):
    from specflow.sources.fixed_width import parse_fixed_width

    spec = FileSpec("f", "f", "FIXED_WIDTH", (FieldSpec("n", "INTEGER", start_position=0, length=6), FieldSpec("t", start_position=6, length=8)))
    records = from_columns(spark.createDataFrame([(1, "42", "ab"), (2, "7", "much too long")], "k int, n string, t string"), spec, seq="k")
    line = generators.line_of("FIXED_WIDTH", ["n", "t"], widths={"n": 6, "t": 8}, numeric={"n"})
    made = records.select("_file", "_seq", line.alias("_raw"))
    assert [r._raw for r in made.orderBy("_seq").collect()] == ["000042ab      ", "000007much too"]
    assert [r.f_n for r in parse_fixed_width(made, spec).orderBy("_seq").collect()] == ["42", "7"]


def test_too_wide_values_are_reported_and_numbers_never_cut(spark):
    spec = FileSpec("f", "f", "FIXED_WIDTH", (FieldSpec("n", "INTEGER"), FieldSpec("t")))
    records = from_columns(spark.createDataFrame([(1, "123456", "ab"), (2, "7", "too long"), (3, "8", "a\nb")], "k int, n string, t string"), spec, seq="k")
    options = {"widths": {"n": 4, "t": 4}, "numeric": {"n"}}
    made = records.select(generators.line_of("FIXED_WIDTH", ["n", "t"], **options).alias("line"), generators.misfits("FIXED_WIDTH", ["n", "t"], **options).alias("odd"))
    rows = made.collect()
    assert rows[0].line == "123456ab  "
    assert [[(i.field, i.severity, i.raw_value) for i in r.odd] for r in rows] == [[("n", "FATAL", "123456")], [("t", "WARNING", "too long")], [("t", "FATAL", "a\nb")]]


def test_csv_keeps_quotes_and_line_breaks(spark):
    import csv
    import io

    values = ['say "hi"', "a,b", "two\nlines", "plain", '"', "", 'x"y,z\r']
    frame = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "k int, a string, b string")
    spec = FileSpec("c", "c", "CSV", (FieldSpec("a"), FieldSpec("b")))
    for r in from_columns(frame, spec, seq="k").select("_seq", generators.line_of("CSV", ["a", "b"]).alias("line")).collect():
        assert next(csv.reader(io.StringIO(r.line, newline=""))) == [values[r._seq]] * 2


def test_bank_file(spark):
    from specflow.sinks import nacha

    rows = spark.createDataFrame([("f", i, "27" if i % 2 else "22", "09100001" + str(i % 10), f"A{i}", 100 * i, i) for i in range(1, 8)],
                                 "file string, nth bigint, code string, routing string, account string, cents bigint, individual_id bigint")
    constants = {"destination": "1", "origin": "2", "created_on": "260101", "created_at": "0600", "modifier": "A", "destination_name": "D", "origin_name": "O",
                 "reference": "", "service_class": "200", "company_name": "C", "company_data": "", "company_id": "9", "entry_class": "PPD", "description": "X",
                 "described_on": "", "effective_on": "260102", "originator": "09100001", "batch_no": "1", "individual_name": "N"}
    lines = [r.line for r in nacha.files(rows, ["file"], "nth", constants).orderBy("line_no").collect()]
    assert [len(x) for x in lines] == [94] * 20 and [x[0] for x in lines] == list("15" + "6" * 7 + "89" + "9" * 9)
    # service class, count, hash (7 times 09100001), debits (odd), credits (even)
    assert lines[9][1:44] == "200" + "000007" + "0063700007" + "000000001600" + "000000001200"
    assert lines[10][1:55] == "000001" + "000002" + "00000007" + "0063700007" + "000000001600" + "000000001200"


def test_upsert_needs_a_key(spark):
    with pytest.raises(ValueError, match="key"):
        writers.to_database(spark.range(1), {"write_mode": "UPSERT_ON_KEY", "connection": {}})
    with pytest.raises(ValueError, match="MERGE"):
        writers.to_database(spark.range(1), {"write_mode": "MERGE", "connection": {}})


def test_xml_round_trip(spark):
    from specflow.sources.xml_records import parse_xml_text

    spec = load_spec({"id": "x", "format": "XML", "metadata": {"recordXPath": "/r/record"}, "fields": [{"name": "a", "path": "a"}, {"name": "b", "path": "b", "required": False}]})
    records = from_columns(spark.createDataFrame([(1, "x & <y>", None)], "k int, a string, b string"), spec, seq="k")
    made = records.select("_file", "_seq", generators.line_of("XML", ["a", "b"]).alias("_xml"))
    row = parse_xml_text(made, spec).first()
    assert row.f_a == "x & <y>" and row.f_b is None


def test_control_record(spark):
    frame = spark.createDataFrame([("d", "27", "02100002", 100), ("d", "22", "11111111", 250)], "day string, code string, routing string, cents int")
    row = generators.totals(frame, ["day"], F.col("cents"), F.col("code"), F.col("routing")).first()
    assert (row.entryCount, row.totalDebit, row.totalCredit, row.entryHash, row.blockCount) == (2, 100, 250, 13211113, 1)


def test_outbound_run(spark, records):
    spec = load_spec({"id": "o", "format": "CSV", "fields": [{"name": "boat"}, {"name": "catch"}, {"name": "seen"}], "outbound": {
        "format": "DELIMITED", "delimiter": "~", "fieldOrder": ["kilos"],
        "fieldMappings": [{"sourceField": "boat", "targetField": "vessel", "transform": "LOWERCASE"}, {"sourceField": "catch", "targetField": "kilos", "transform": "FORMAT_DECIMAL_2DP"},
                          {"sourceField": "seen", "targetField": "on", "transform": "FORMAT_DATE:ddMMyyyy"}, {"sourceField": "port", "targetField": "port", "defaultValue": "north"}],
        "correctionRules": [{"field": "port", "type": "UPPERCASE"}],
        "validationRules": [{"field": "vessel", "type": "MIN_LENGTH", "value": "3", "severity": "FATAL", "message": "short"}]}})
    rows = [{"boat": "IDA", "catch": "812.345", "seen": "2023-11-02"}, {"boat": "X", "catch": "1", "seen": None},
            {"boat": "Olga", "catch": "$12.50", "seen": "11/02/2023"}, {"boat": "two\nlines", "catch": "0.004", "seen": None}]
    run = outbound.generate(records(spec, *rows), spec, ("_seq",))
    assert sorted(r.line for r in run.lines.collect()) == ["$12.50~olga~11/02/2023~NORTH", "812.35~ida~02112023~NORTH"]
    assert tuple(run.summary.first()) == (2, 2)
    # what a transform cannot read stays as it is and is reported
    issues = {r._seq: [(e.field, e.severity) for e in r._errors] for r in run.routed.collect()}
    assert issues[2] == [("kilos", "ERROR"), ("on", "ERROR")] and issues[3] == [("vessel", "FATAL")]
    with pytest.raises(SpecError):
        outbound.mapped_records(records(SPEC, {}), SPEC)


def test_file_to_file_with_header(lines):
    from dataclasses import replace

    spec = replace(SPEC, output_spec=OutputSpec("CSV", delimiter=";", field_mappings=(FieldMapping("amount", "sum"), FieldMapping("id", "key", transformation="lpad(value, 4, '0')"))))
    out = file_to_file.convert(parse_delimited(lines("1,$5,,", "2,6,,"), spec), spec)
    assert [r.line for r in file_to_file.with_header(out, spec).orderBy("_seq").collect()] == ["sum;key", "5;0001", "6;0002"]


def test_mapping_extensions(records):
    register_transform("TWICE", lambda c, a: F.concat(c, c))
    done = map_fields(records(SPEC, {"id": "1"}), (FieldMapping("id", "x", "TWICE"),))
    assert done.first().f_x == "11"
    with pytest.raises(SpecError):
        map_fields(records(SPEC, {"id": "1"}), (FieldMapping("id", "x", "NOPE"),))
    with pytest.raises(UnsupportedFormatError):
        generators.line_of("PDF", ["a"])


def test_fan_out(spark, folder):
    frame = spark.range(10)

    def broken(df):
        raise RuntimeError("no disk")

    routes = {"a": (None, lambda d: d.write.parquet(f"{folder}/a")), "bad": (None, broken), "c": ("id < 3", lambda d: d.write.parquet(f"{folder}/c"))}
    assert writers.fan_out(frame, routes, "SEQUENTIAL") == {"a": "SUCCESS", "bad": "FAILED: RuntimeError", "c": "SKIPPED"}
    del routes["a"]
    assert writers.fan_out(frame, routes, "BEST_EFFORT") == {"bad": "FAILED: RuntimeError", "c": "SUCCESS"}
    assert spark.read.parquet(f"{folder}/c").count() == 3


def test_sinks(spark, folder):
    write(spark.range(4), "OUTPUT_FILE", {"path": f"{folder}/f", "format": "json"})
    assert spark.read.json(f"{folder}/f").count() == 4
    seen = []
    register_sink("MINE", lambda df, options: seen.append((df.count(), options["x"])))
    write(spark.range(2), "MINE", {"x": 1})
    assert seen == [(2, 1)]
    with pytest.raises(ValueError):
        write(spark.range(1), "NOWHERE", {})
    with pytest.raises(ValueError):
        write(spark.range(1), "KAFKA_TOPIC", {})


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    source = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, t int")
    assert sorted(map(tuple, writers.upserted(target, source, ["id"], ["t"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_run_files(spark, folder):
    with open(f"{folder}/a.csv", "w") as out:
        out.write("1,5,,\nx,6,,\n")
    run = inbound.run_files(spark, folder, SPEC, skip_invalid=True)
    row = run.summary.first()
    assert (row.total_records, row.successful_records, row.failed_records, row.status) == (2, 1, 1, "COMPLETED_WITH_ERRORS")
    assert run.quarantine.count() == 1 and run.passed.count() == 1

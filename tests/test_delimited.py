import random

import pytest
from pyspark.sql import functions as F

from specflow.sources import read_records
from specflow.sources.delimited import parse_delimited, split_quoted
from specflow.sources.lines import number_lines, read_lines
from specflow.spec import SpecError, load_spec

SHELF = {"id": "shelf", "format": "CSV", "hasHeader": True, "fields": [
    {"name": "weight", "type": "DECIMAL", "columnName": "kg"},
    {"name": "remark", "columnName": "remark", "required": False},
    {"name": "crate", "type": "LONG", "columnName": "crate_no"},
    {"name": "bay", "columnName": "bay"},
    {"name": "sealed", "type": "BOOLEAN", "columnName": "sealed", "required": False}]}


def read(spark, folder, text, **changes):
    with open(f"{folder}/in.csv", "w", encoding="utf-8") as out:
        out.write(text)
    return read_records(spark, folder, load_spec({**SHELF, **changes})).orderBy("_seq").collect()


def test_cells_go_to_the_fields_their_header_names(spark, folder):
    rows = read(spark, folder, "bay,sealed,kg,remark,crate_no\nnorth 3,yes,12.750,,90071992547\nsouth,no,0.5,cracked,-4\n")
    assert [(r.f_crate, r.f_bay, r.f_weight, r.f_sealed, r.f_remark) for r in rows] == [
        ("90071992547", "north 3", "12.750", "true", None), ("-4", "south", "0.5", "false", "cracked")]
    assert not any(r._errors for r in rows) and [r._seq for r in rows] == [0, 1]


def test_quoted_delimiters_and_lines_without_content(spark, folder):
    rows = read(spark, folder, 'kg,bay,crate_no,remark\n\t \n1,"lower, left, behind",8,"so ""called"" bay"\n\n2,"x"y"z",9,\n   ')
    assert [(r.f_bay, r.f_remark) for r in rows] == [("lower, left, behind", "so called bay"), ("xyz", None)]
    assert [r._seq for r in rows] == [0, 1]


def test_headers_may_lack_what_is_optional_only(spark, folder):
    row = read(spark, folder, "crate_no,kg\n5,1.5\n")[0]
    assert row.f_remark is None and row.f_sealed is None
    assert [(e.field, e.message) for e in row._errors] == [("bay", "Column 'bay' not found in header")]


@pytest.mark.parametrize("delimiter", ["|", "\t", "||", ";", "~^"])
def test_delimiters(spark, folder, delimiter):
    lines = [["remark", "crate_no", "bay", "kg"], ["a, b", "31", "east", "4"], ["", "32", "", "x"]]
    rows = read(spark, folder, "\n".join(map(delimiter.join, lines)), format="DELIMITED", delimiter=delimiter)
    assert [(r.f_crate, r.f_bay, r.f_remark, len(r._errors)) for r in rows] == [("31", "east", "a, b", 0), ("32", None, None, 2)]


def test_every_bad_cell_is_told_and_kept(spark, folder):
    rows = read(spark, folder, "crate_no,bay,kg,sealed\n12,west,heavy,\n1.5,,3,\n,,,perhaps\n")
    assert [sorted(e.field for e in r._errors) for r in rows] == [["weight"], ["bay", "crate"], ["bay", "crate", "weight"]]
    assert (rows[0].f_weight, rows[1].f_crate, rows[2].f_sealed) == ("heavy", "1.5", "false")
    assert {e.message for e in rows[0]._errors} == {"Cannot convert 'weight' value 'heavy' to DECIMAL"}
    assert {e.message for e in rows[1]._errors} == {"Cannot convert 'crate' value '1.5' to LONG", "Required field 'bay' is missing or empty"}


def test_numbers_run_over_many_splits(spark, folder):
    body = "".join(f"b{i},{i}.25,{i}\n" + (" \n" if i % 11 == 5 else "") for i in range(7_321))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = read(spark, folder, "made by hand\n\nbay,kg,crate_no\n" + body, skipLinesCount=2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r.f_crate) for r in rows] == [r._seq for r in rows] == list(range(7_321))


def test_each_file_has_its_own_header_and_numbers(spark, folder):
    for name, text in (("one", "kg,bay,crate_no\n1,p,70\n2,q,71\n"), ("two", "CRATE_NO, Bay ,kg\n72,r,3\n")):
        with open(f"{folder}/{name}.csv", "w") as out:
            out.write(text)
    rows = read_records(spark, folder, load_spec(SHELF)).collect()
    assert sorted((r._file[-7:], r._seq, r.f_crate, r.f_bay) for r in rows) == [
        ("one.csv", 0, "70", "p"), ("one.csv", 1, "71", "q"), ("two.csv", 0, "72", "r")]


def numbered(spark, folder, skip=0):
    return number_lines(read_lines(spark, folder), skip=skip)[0]


def test_shuffle_join_gives_the_same_numbers(spark, folder):
    with open(f"{folder}/t.txt", "w") as out:
        out.write("".join(f"{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = numbered(spark, folder, 3).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 497 and all(int(r._raw) == r._line == r._seq + 3 for r in rows)


def test_numbers_hold_when_executors_come_or_go(spark, folder):
    """The number of cores decides how files are cut; it may change between the two scans."""
    with open(f"{folder}/t.txt", "w") as out:
        out.write("".join("\n" if i % 7 == 3 else f"{i}\n" for i in range(20_000)))
    changed = {"spark.sql.files.openCostInBytes": "1", "spark.sql.leafNodeDefaultParallelism": "4"}
    pinned = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        data = numbered(spark, folder)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
        rows = sorted((r._line, r._seq, r._raw) for r in data.collect())
        filled = [i for i in range(20_000) if i % 7 != 3]
        assert rows == [(i, nth, str(i)) for nth, i in enumerate(filled)]
        # other cuts, against the pin, stop the job
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        with pytest.raises(Exception, match="cut differently"):
            data.filter("_line >= 0").collect()
    finally:
        for k in [*changed, "spark.sql.files.minPartitionNum"]:
            spark.conf.unset(k)
        if pinned:
            spark.conf.set("spark.sql.files.minPartitionNum", pinned)


def test_control_characters_stay(spark):
    frame = spark.createDataFrame([('"a\x01b",\x02c,"d,e"f""g',)], "v string")
    assert frame.select(split_quoted(F.col("v"), ",").alias("o")).first().o == ["a\x01b", "\x02c", "d,efg"]


@pytest.mark.parametrize("charset", ["ISO-8859-1", "windows-1252", "UTF-16", "UTF-16LE", "UTF-16BE"])
def test_charsets_with_blank_and_skipped_lines(spark, folder, charset):
    import os

    os.makedirs(f"{folder}/in")
    lines = ["", "skip", "id|name", "1|Ærø", "", "2|naïve café", "3|" + "ü" * 300]
    with open(f"{folder}/in/a.txt", "wb") as out:
        out.write("\n".join(lines).encode(charset) + "\n".encode("utf-16-le" if charset == "UTF-16" else charset))
    spec = load_spec({"id": "c", "format": "DELIMITED", "delimiter": "|", "encoding": charset, "hasHeader": True, "skipLinesCount": 2,
                      "fields": [{"name": "id", "columnName": "id"}, {"name": "name", "columnName": "name"}]})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        rows = sorted((r._seq, r.f_id, r.f_name) for r in read_records(spark, f"{folder}/in", spec).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(0, "1", "Ærø"), (1, "2", "naïve café"), (2, "3", "ü" * 300)]


def toggle_split(line, delimiter):
    out, cell, quoted, i = [], "", False, 0
    while i < len(line):
        if line[i] == '"':
            quoted = not quoted
        elif not quoted and line.startswith(delimiter, i):
            out.append(cell)
            cell = ""
            i += len(delimiter) - 1
        else:
            cell += line[i]
        i += 1
    return [*out, cell]


@pytest.mark.parametrize("delimiter", [",", "|", "||", "\t"])
def test_random_lines_against_a_plain_scan(spark, delimiter):
    rng = random.Random(7)
    texts = ["".join(rng.choice(['"', delimiter, "a", "b ", " ", "|", ","]) for _ in range(rng.randrange(0, 18))) for _ in range(600)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in frame.select("i", split_quoted(F.col("t"), delimiter).alias("p")).collect()}
    assert all(got[i] == toggle_split(t, delimiter) for i, t in enumerate(texts))


def test_index_beats_name_and_short_rows(lines):
    spec = load_spec({"id": "s", "format": "CSV", "fields": [
        {"name": "a", "columnIndex": 1, "columnName": "x"}, {"name": "b", "columnIndex": 5, "required": False, "defaultValue": "d"}]})
    row = parse_delimited(lines("1,2"), spec, header="x,y").first()
    assert (row.f_a, row.f_b) == ("2", "d")


def test_spec_is_checked_before_reading(lines):
    with pytest.raises(SpecError):
        parse_delimited(lines("1"), load_spec({"id": "s", "format": "CSV", "fields": [{"name": "a"}]}))


@pytest.mark.parametrize("kind, raw, value, bad", [
    ("INTEGER", "007", "7", False), ("INTEGER", "+5", "5", False), ("INTEGER", "5.0", "5.0", True),
    ("INTEGER", "99999999999", "99999999999", True), ("LONG", "99999999999", "99999999999", False),
    ("DECIMAL", "100.50", "100.50", False), ("DECIMAL", "+007.10", "7.10", False), ("DECIMAL", ".5", "0.5", False),
    ("DECIMAL", "$1,234.56", "$1", True), ("DECIMAL", "1e3", "1000", False), ("DECIMAL", "-0.5", "-0.5", False),
    ("BOOLEAN", "YES", "true", False), ("BOOLEAN", "whatever", "false", False), ("DATE", "nonsense", "nonsense", False),
])
def test_coercion(lines, kind, raw, value, bad):
    spec = load_spec({"id": "s", "format": "CSV", "fields": [{"name": "v", "type": kind, "columnIndex": 0}]})
    row = parse_delimited(lines(raw), spec).first()
    assert row.f_v == value and bool(row._errors) == bad


def test_sensitive_values_do_not_leak(lines):
    spec = load_spec({"id": "s", "format": "CSV", "fields": [{"name": "pin", "type": "INTEGER", "columnIndex": 0, "sensitive": True}]})
    error = parse_delimited(lines("secret"), spec).first()._errors[0]
    assert error.raw_value is None and "secret" not in error.message and "***" in error.message


def test_odd_white_space_is_trimmed(lines):
    spec = load_spec({"id": "s", "format": "CSV", "fields": [{"name": "v", "columnIndex": 0}]})
    assert parse_delimited(lines("   x　\t"), spec).first().f_v == "x"


def test_names_with_quotes_and_backslashes(lines):
    spec = load_spec({"id": "s", "format": "CSV", "fields": [{"name": "o'k\\e`y", "type": "INTEGER", "columnIndex": 0}]})
    assert parse_delimited(lines("x"), spec).first()._errors[0].field == "o'k\\e`y"

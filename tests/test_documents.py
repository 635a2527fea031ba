"""Documents whose markup stands where records are cut: against whole-document parsers."""

import json
import random
from xml.etree import ElementTree

import pytest

from specflow.operators.ordered import carried_states
from specflow.sources import read_records
from specflow.spec import load_spec

XML = load_spec({"id": "x", "format": "XML", "metadata": {"recordXPath": "/doc/list/item"}, "fields": [
    {"name": "note", "xmlAttribute": "note", "required": False}, {"name": "v", "path": "v", "required": False},
    {"name": "w", "path": "w", "required": False}, {"name": "by", "path": "/doc/list/by", "required": False}]})


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.write(text)


def test_markup_in_attributes_and_character_data(spark, folder, small_splits):
    put(folder, "a.xml", '<doc><meta note="a>b"/><list>' + "".join(f'<item note="x > {i}"><v>{i}</v></item>' for i in range(5)) + "</list></doc>")
    put(folder, "b.xml", "<doc><list><item><v><![CDATA[a <item x]]></v></item><item><v><![CDATA[</item> </list>]]>!</v></item></list></doc>")
    put(folder, "c.xml", "<doc><!-- <list><item> --><list><item><v>1<!-- </item> --></v><!-- </item> <item> </item> --><w>2</w></item></list></doc>")
    rows = read_records(spark, folder, XML).collect()
    got = {(r._file[-5], r._seq): (r.f_note, r.f_v, r.f_w) for r in rows}
    want = {("a", i): (f"x > {i}", str(i), None) for i in range(5)}
    want |= {("b", 0): (None, "a <item x", None), ("b", 1): (None, "</item> </list>!", None), ("c", 0): (None, "1", "2")}
    assert got == want


def odd(draw):
    return draw.choice(["plain", "a > b", "it's \"so\"", "</item>", "<item>", "<item/>", "<v>", "</list>", "<!--", "-->", "]]", "/>", "<?x", "&", "é"])


def random_xml(draw):
    def comment():
        return draw.choice(["", "", "", f"<!--{odd(draw).replace('--', '')} {odd(draw).replace('--', '')}-->", f"<?note {odd(draw).replace('?', '')}?>"])

    def text():
        said = "".join(odd(draw) for _ in range(draw.randint(0, 3)))
        if draw.random() < 0.5:
            return f"<![CDATA[{said}]]>"
        return said.replace("&", "&amp;").replace("<", "&lt;")

    def value():
        said = odd(draw).replace("&", "&amp;").replace("<", "&lt;")
        return f"'{said}'" if "'" not in said else '"' + said.replace('"', "&quot;") + '"'

    def item(i):
        inner = [f"<v>{text()}{i}</v>", comment()]
        if draw.random() < 0.5:
            inner.append(f"<w a={value()}>{text()}.</w>")
        return f"<item note={value()}>{''.join(inner)}{comment()}</item>" if draw.random() < 0.9 else f"<item note={value()}/>"

    lists = [
        f"<list>{comment()}<by>{text()}b</by>{''.join(item(i) + comment() for i in range(draw.randint(0, 30)))}</list>"
        f"<other k={value()}><item><v>no</v></item>{text()}</other>" for _ in range(draw.randint(1, 3))
    ]
    head = "<?xml version='1.0'?>" + draw.choice(["", "<!DOCTYPE doc [<!ENTITY e '<item></item>'>]>"])
    return f"{head}{comment()}<doc>{comment()}<deep><list><item><v>no</v></item></list></deep>{''.join(lists)}</doc>"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_xml_like_a_whole_document_parse(spark, folder, small_splits, seed):
    draw, want = random.Random(seed), {}
    for name in "abcdef":
        text = random_xml(draw)
        put(folder, f"{name}.xml", text)
        doc, seq = ElementTree.fromstring(text.encode()), 0
        for block in doc.findall("list"):
            for element in block.findall("item"):
                want[name, seq] = (element.get("note"), element.findtext("v"), element.findtext("w"), block.findtext("by"))
                seq += 1
    got = {(r._file[-5], r._seq): (r.f_note, r.f_v, r.f_w, r.f_by) for r in read_records(spark, folder, XML).collect()}
    assert got == want and len(want) > 50


def test_random_empty_records(spark, folder, small_splits):
    draw, want = random.Random(4), []
    spec = load_spec({"id": "e", "format": "XML", "metadata": {"recordXPath": "/all/row", "emptyRecords": "true"}, "fields": [
        {"name": "a", "xmlAttribute": "a"}, {"name": "b", "xmlAttribute": "b"}]})
    text = "<all>"
    for i in range(200):
        a, b = (f"{draw.choice(['x', '/>', 'a/>b', ' > '])}{i}" for _ in range(2))
        want.append((i, a, b))
        text += f"<row a=\"{a}\" b='{b}'/>" + draw.choice(["", "<!-- <row a='1'/> -->"])
    put(folder, "a.xml", text + "</all>")
    assert sorted((r._seq, r.f_a, r.f_b) for r in read_records(spark, folder, spec).collect()) == want


JSON = load_spec({"id": "j", "format": "JSON", "fields": [
    {"name": "id", "type": "INTEGER", "path": "$.id"}, {"name": "text", "path": "$.body.text", "required": False},
    {"name": "first", "path": "$.tags[0]", "required": False}]})


def random_records(draw, n):
    bits = ["plain", "}", "{", "]", "[", '"', "\\", "\n", ",", "é", "}, {", '\\"}']
    out = []
    for i in range(n):
        said = "." + "".join(draw.choice(bits) for _ in range(draw.randint(1, 4))) + "."
        out.append({"id": i, "body": {"text": said, "more": [{"x": {}}, said]}, "tags": [f"t{said}"]})
    return out


def shown(rows):
    return {(r._file.rsplit("/", 1)[1], r._seq): (r.f_id, r.f_text, r.f_first, bool(r._errors)) for r in rows}


@pytest.mark.parametrize("layout", [None, "DOCUMENT"])
def test_json_documents_of_every_kind(spark, folder, small_splits, layout):
    draw, want = random.Random(6), {}
    shapes = {
        "array": lambda r: json.dumps(r), "pretty": lambda r: json.dumps(r, indent=2), "ascii": lambda r: "\n " + json.dumps(r, ensure_ascii=False, indent=1) + "\n",
        "stream": lambda r: "\n".join(json.dumps(x, indent=1) for x in r), "lines": lambda r: "\n".join(json.dumps(x) for x in r) + "\n",
        "none": lambda r: "[]", "blank": lambda r: " \n",
    }
    for name, shape in shapes.items():
        records = [] if name in ("none", "blank") else random_records(draw, 40)
        put(folder, name, shape(records))
        want |= {(name, i): (str(r["id"]), r["body"]["text"], r["tags"][0], False) for i, r in enumerate(records)}
    spec = JSON if layout is None else load_spec({"id": "j", "format": "JSON", "metadata": {"jsonLayout": layout}, "fields": [
        {"name": "id", "type": "INTEGER", "path": "$.id"}, {"name": "text", "path": "$.body.text", "required": False}, {"name": "first", "path": "$.tags[0]", "required": False}]})
    assert shown(read_records(spark, folder, spec).collect()) == want


def test_bad_elements_are_reported(spark, folder, small_splits):
    put(folder, "a", '[ 7, {"id": 1}, "x}", [2, 3], {"id": 4}, null, true ]\n')
    put(folder, "b", '[1, 2]')
    put(folder, "c", '[{"id": 1}, {"id": 2')
    put(folder, "d", '[{"id": 1}, {"id": }, {"id": 3}]')
    rows = {k: (id, bad) for k, (id, _, _, bad) in shown(read_records(spark, folder, JSON).collect()).items()}
    assert [rows["a", i] for i in range(7)] == [(None, True), ("1", False), (None, True), (None, True), ("4", False), (None, True), (None, True)]
    assert [rows["b", i][1] for i in range(2)] == [True, True]
    assert rows["c", 0] == ("1", False) and rows["c", 1] == (None, True)
    assert [rows["d", i] for i in range(3)] == [("1", False), (None, True), ("3", False)]
    assert len(rows) == 7 + 2 + 2 + 3


def test_states_are_carried_through_every_level(spark, monkeypatch):
    monkeypatch.setattr("specflow.operators.ordered.FAN", 4)
    draw = random.Random(8)
    rows, want = [], {}
    for group, n in (("a", 150), ("b", 1), ("c", 17)):
        state = 0
        for i in range(n):
            table = [draw.randint(0, 2) for _ in range(3)]
            rows.append((group, i, table))
            want[group, i] = state
            state = table[state]
    df = spark.createDataFrame(rows, "g string, n bigint, t array<tinyint>").repartition(5)
    assert {(r.g, r.n): r.state for r in carried_states(df, ("g",), "n", "t", 3).collect()} == want


def test_records_are_not_gathered_on_the_driver(spark, folder, monkeypatch):
    """Paths that repeat make the stored rows look small: they are joined by a shuffle, and headers are parsed once a block."""
    from specflow import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    for i in range(2):
        put(folder, f"{i}.xml", f"<doc><list><by>b{i}</by>" + "".join(f"<item><v>{k}</v></item>" for k in range(3)) + "</list></doc>")
    done = read_records(spark, folder, XML)
    plan = done._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert not [line for line in joins if "Broadcast" in line and ("_nth" in line or "_no_" in line)]
    assert len([line for line in joins if "SortMergeJoin" in line]) == 2
    assert plan.count("from_xml(") == 1
    assert sorted((r._file[-5], r._seq, r.f_v, r.f_by) for r in done.collect()) == [(str(i), k, str(k), f"b{i}") for i in range(2) for k in range(3)]

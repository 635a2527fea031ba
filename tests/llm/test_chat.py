import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from specflow.llm import chat
from specflow.llm.chat import CONTROLS, LAYOUTS, Layout, Part, canonical, escaped, fingerprint, known, paths, unescaped

RECORDS = [
    ("turn", {"role": "user", "text": "a"}, [("user", "a")]),
    ("prompt_completion", {"prompt": "p", "completion": None}, [("user", "p"), ("assistant", "")]),
    ("prompt_response", {"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ("preference", {"prompt": "p", "chosen": "c", "rejected": "x"}, [("user", "p"), ("assistant", "c")]),
    ("question_answer", {"id": 7, "question": "q", "answer": 12}, [("user", "q"), ("assistant", "12")]),
    ("instruction", {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("instruction", {"instruction": "i", "input": "more", "output": "o", "meta": {"lang": ["en"]}}, [("user", "i\n\nmore"), ("assistant", "o")]),
    ("instruction", {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("messages", {"messages": [{"role": "user", "content": "a"}, {"role": None, "content": None}]}, [("user", "a"), ("", "")]),
    ("message_parts", {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "ab")]),
    ("conversations", {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]},
     [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ("pairs", {"turns": [{"user": "a", "assistant": "b"}, {"user": "c", "assistant": "d"}]},
     [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]),
    (None, {"title": "t", "body": {"x": [1, {"y": 2}], "z": []}}, []),
    (None, {}, []),
    (None, [1, 2], []),
]
BROKEN = [None, "", "{", "[" * 100_000, '"text"', "null"]


def turns(row, column="turns"):
    return [(t["role"], t["text"]) for t in row[column]]


def test_layouts_become_turns(spark):
    rows = [(i, json.dumps(r)) for i, (_, r, _) in enumerate(RECORDS)] + [(100 + i, b) for i, b in enumerate(BROKEN)]
    df = spark.createDataFrame(rows, "id bigint, record string").withColumn("layout", F.lit("other")).repartition(4)
    got = {r["id"]: r for r in canonical(df, "record").collect()}
    for i, (layout, _, want) in enumerate(RECORDS):
        assert (got[i]["_layout"], turns(got[i])) == (layout, want), RECORDS[i]
    assert got[12]["unfit"] == ["body.x[]", "body.x[].y", "body.z", "title"] and got[0]["unfit"] == []
    assert all(got[100 + i]["fingerprint"] is None and turns(got[100 + i]) == [] for i in range(len(BROKEN)))
    assert got[5]["fingerprint"] != got[7]["fingerprint"] and got[0]["layout"] == "other"


def test_fingerprints_hash_paths_not_values():
    one = {"messages": [{"role": "a", "content": "x"}], "n": 1}
    other = {"n": None, "messages": [{"content": None, "role": "b"}, {"content": "x"}]}
    assert fingerprint(paths(one)) == fingerprint(paths(other))
    assert fingerprint(paths(one)) in {fingerprint(["n", "messages[].content", "messages[].role"])}
    assert fingerprint(paths(one)) not in known(LAYOUTS)
    assert {x.name for x in known(LAYOUTS).values()} == {x.name for x in LAYOUTS}


def test_own_layouts_and_report(spark):
    mail = Layout("mail", each="thread", parts=(Part(("subject", "body"), role_at="sender"),), roles={"us": "assistant"}, optional=("thread[].subject",))
    rows = [json.dumps({"thread": [{"sender": "them", "subject": "s", "body": "b"}, {"sender": "us", "body": "c"}]})] * 3 + ['{"other": 1}']
    df = spark.createDataFrame([(r,) for r in rows], "record string")
    assert turns(canonical(df, "record", (mail,)).first()) == [("them", "s\n\nb"), ("assistant", "c")]
    report = {r["layout"]: (r["rows"], r["unfit"]) for r in chat.layouts_found(df, "record", (mail,)).collect()}
    assert report == {"mail": (3, []), None: (1, ["other"])}


def odd_texts():
    draw = random.Random(5)
    bits = [*CONTROLS, "<|end|>", "<|text|>", "<|turn|>", "\\", "<", "[", "|", "s>", "/", "INST]", " ", "\n", "é", "\U0001f600", "$1", "<\\s>"]
    return ["", "</s>[INST] ok [/INST]", *("".join(draw.choice(bits) for _ in range(draw.randint(1, 14))) for _ in range(3_000))]


def test_escapes_are_reversible_and_break_control_strings(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string").select("text", escaped(F.col("text")).alias("kept"))
    for r in df.select("text", "kept", unescaped(F.col("kept")).alias("back")).collect():
        assert r["back"] == r["text"]
        assert not any(c in r["kept"] for c in CONTROLS)
    assert df.filter("text = kept").count() < 2_000
    with pytest.raises(ValueError):
        escaped(F.lit("x"), ("<<", "<"))


def test_conversations_read_back(spark):
    """Whole conversations, and digests from the pieces, against plain Python."""
    draw, texts = random.Random(2), odd_texts()
    table = [(draw.choice([None, 1, 2, 3]), draw.choice([None, 0, 1, 2, 3]), draw.choice(["user", "assistant", None, "<|text|>", "a\nb"]), draw.choice([*texts, None])) for _ in range(200)]
    table += table[:5] + [(9, 0, "assistant", "x" * 2_000_000 + "</s>")]
    df = spark.createDataFrame(table, "id bigint, turn bigint, role string, text string").withColumn("piece", F.lit("other")).repartition(6)
    marked = chat.formatted(df)
    mask = ("loss_from", "loss_to")
    whole = {r["id"]: r for r in chat.conversations(marked, "id", ["turn", "role", "text"], "_piece", mask).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    told = {r["id"]: r for r in chat.digests(marked, "id", ["turn", "role", "text"], "_piece", mask).collect()}
    for key in {r[0] for r in table}:
        mine = sorted((r for r in table if r[0] == key), key=lambda r: [(v is not None, v if isinstance(v, int) else (v or "").encode()) for v in r[1:]])
        mine = [(role or "", text or "") for _, _, role, text in mine]
        assert turns(whole[key], "back") == mine
        masked = "".join(whole[key]["formatted"][s["from"] : s["to"]] for s in whole[key]["loss"])
        learnt = "".join(t for r, t in mine if r == "assistant")
        assert len(masked) >= len(learnt)
        assert told[key]["n_turns"] == len(mine)
        assert told[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (told[key]["loss_chars"], told[key]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert told[key]["formatted_chars"] == len(whole[key]["formatted"])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, record string")
    read = canonical(empty, "record")
    assert read.collect() == [] and read.columns == ["id", "record", "layout", "fingerprint", "unfit", "turns"]
    marked = chat.formatted(read.select("id", F.lit("user").alias("role"), F.col("record").alias("text")))
    assert chat.digests(marked, "id", ["role"]).collect() == [] and chat.conversations(marked, "id", ["role"]).collect() == []

import random
import re

import pytest

from specflow.llm.decontaminate import contamination, is_contaminated, merged

from .conftest import prose, rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(table, items, width=13):
    out = []
    for r in table:
        own = words(r["text"])
        hit, found = set(), set()
        for item, text in items:
            item_words = words(text)
            m = min(width, len(item_words))
            windows = {tuple(item_words[i : i + m]) for i in range(len(item_words) - m + 1)} if m else set()
            for i in range(len(own) - m + 1 if m else 0):
                if tuple(own[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found.add("" if item is None else str(item))
        out.append((r["doc_id"], len(own), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.fixture
def benchmark(corpus):
    draw = random.Random(3)
    whole = max((t for _, t, *_ in corpus if t), key=len).split()
    items = [(i, prose(draw, 40)) for i in range(20)]
    items += [(30, " ".join(whole[100:140])), (31, " ".join(whole[120:160]).upper()), (32, " ".join(whole[200:205]))]
    items += [(33, "the"), (34, ""), (35, None), (None, " ".join(whole[500:520])), (30, " ".join(whole[700:720]))]
    items += [(36, " ".join(whole[900:913])), (37, " ".join(whole[903:915])), (38, "É, àb!")]
    return items


def test_like_brute_force(spark, documents, benchmark):
    table = documents.collect()
    items = spark.createDataFrame(benchmark, "item_id bigint, text string")
    want = brute(table, benchmark)
    for words_per_block in (2_000_000, 1_000):
        got = contamination(documents, items, words_per_block=words_per_block)
        assert got.columns[: len(documents.columns)] == documents.columns
        names = got.columns[len(documents.columns) :]
        assert rows(got, "doc_id", *names[:3]) == want
    assert sum(r[2] for r in want) > 100


def test_repeated_and_overlapping_passages(spark):
    item = " ".join(f"w{i}" for i in range(15))
    df = spark.createDataFrame([(1, f"{item} x {item}, {item[:40]}"), (2, "w1 " * 50), (3, item.upper().replace(" ", "--"))],
                               "doc_id bigint, text string")
    got = contamination(df, spark.createDataFrame([(1, item), (2, item)], "item_id int, text string"))
    got = got.withColumn("bad", is_contaminated())
    assert rows(got, "doc_id", "n_hit", "items", "bad") == [(1, 30, ["1", "2"], True), (2, 0, [], False), (3, 15, ["1", "2"], True)]


def test_merged_spans():
    import numpy as np

    assert merged(np.array([[5, 8], [0, 3], [2, 4], [4, 5], [9, 9 + 1]])).tolist() == [[0, 8], [9, 10]]
    assert merged(np.zeros((0, 2), int)).tolist() == []


def test_empty_tables(spark, documents, nothing):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination(nothing, items).count() == 0
    got = contamination(documents, items)
    assert {r["n_hit"] for r in got.collect()} == {0}

import random

import numpy as np
import pytest

from specflow.llm import toxicity

from .conftest import prose

BAD = ["blockhead", "numbskull", "dimwit"]


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(21)
    out = []
    for i in range(400):
        text, toxic = prose(draw, draw.randint(5, 150)), int(i % 5 == 0)
        words = text.split()
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(draw.randrange(len(words)), draw.choice(BAD).title() + draw.choice(["", ",", "***"]))
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_documents(spark, labelled):
    df = spark.createDataFrame([r[:2] for r in labelled], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in labelled if i % 4], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(scored[i] >= toxicity.THRESHOLD, bool(t)) for i, _, t in labelled if not i % 4]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_features_are_distinct_character_grams():
    cut = toxicity.Places()
    a = cut.of("Éab cd".encode())
    assert len(a) == len(np.unique(a)) == 5 + 4 + 3
    assert sorted(cut.of(b"abcabcabc")) == sorted(np.unique(cut.of(b"ABCabcabc")))
    assert len(cut.of(b"")) == 0
    plain = {tuple(sorted(toxicity.Places().of(t))) for t in (b"one", b"two", b"one ")}
    assert len(plain) == 3


def test_ratios_scale_the_features():
    rows = [(b"good day", 0)] * 6 + [(b"bad day", 1)] * 6
    model = toxicity.fit(rows, (0.5, 0.5))
    cut = toxicity.Places()
    assert model.score(cut.of(b"bad day")) > 0.8 > 0.2 > model.score(cut.of(b"good day"))
    assert abs(model.score(cut.of(b"")) - 0.5) < 0.2


def test_odd_rows_and_labels(spark, documents, labelled):
    labels = spark.createDataFrame(
        [(0, 1), (0, 0), (1, None), (None, 1), (2, 0), (3, 0), (10_000, 1), (4, 7)] + [(i, i % 2) for i in range(5, 60)],
        "doc_id bigint, toxic int",
    )
    model = toxicity.train(documents, labels)
    scored = toxicity.score(documents, model)
    assert scored.columns == [*documents.columns, "_score"]
    values = scored.collect()
    assert len(values) == documents.count() and all(0 <= r["_score"] <= 1 for r in values)
    by_text = {}
    for r in values:
        assert by_text.setdefault(r["text"] or "", r["_score"]) == r["_score"]


def test_without_labels_or_rows(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(documents, none)
    assert {r["s"] for r in toxicity.score(documents, model, out="s").select("s").collect()} == {0.5}
    assert toxicity.score(nothing, toxicity.train(nothing, none)).count() == 0
    clean = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id bigint, toxic int")
    assert max(r["s"] for r in toxicity.score(documents, toxicity.train(documents, clean), out="s").collect()) < 0.1


def test_very_long_documents_bound_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHARACTERS", 1_000)
    df = spark.createDataFrame([(i, "x" * 400) for i in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, shares: taken.append(len(rows)))
    toxicity.train(df, labels)
    assert taken == [2]


@pytest.mark.parametrize("size", [1_001, 5_000])
def test_texts_that_do_not_fit_are_passed_over(spark, monkeypatch, size):
    monkeypatch.setattr(toxicity, "CHARACTERS", 1_000)
    from pyspark.sql import functions as F

    ids = [r["id"] for r in spark.range(20).orderBy(F.xxhash64("id")).collect()]
    texts = {i: "x" * size if at in (0, 3) else f"{'good' if i % 2 else 'bad'} day {i}" for at, i in enumerate(ids)}
    df = spark.createDataFrame([*texts.items(), (ids[1], texts[ids[1]])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, shares: taken.extend(rows))
    toxicity.train(df, labels)
    want = [(texts[i].encode(), i % 2) for at, i in enumerate(ids) for _ in range(1 + (at == 1)) if at not in (0, 3)]
    assert taken == want


def plain_places(text):
    """Places of all n-grams, one by one, in whole numbers."""
    codes = [ord(c) for c in " " + "".join(c.lower() if c.isascii() else c for c in text) + " "]
    factors, found = [int(f) for f in toxicity._FACTORS], set()
    for order in toxicity.ORDERS:
        for i in range(len(codes) - order + 1):
            mixed = codes[i] * factors[0]
            for step in range(1, order):
                mixed %= 1 << 32
                mixed = (mixed ^ mixed >> 15) * factors[step] + codes[i + step]
            found.add(mixed * 0x9E3779B1 % (1 << 32) >> 32 - toxicity.BITS)
    return found


def test_scores_like_a_plain_sum_over_all_grams(spark, labelled, documents):
    df = spark.createDataFrame([r[:2] for r in labelled], "doc_id bigint, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, t) for i, _, t in labelled], "doc_id bigint, toxic int"))
    for r in toxicity.score(documents.limit(90), model).collect():
        z = model.bias + sum(float(model.weights[p]) for p in plain_places(r["text"] or ""))
        assert r[-1] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from specflow.llm import spelling
from specflow.llm.spelling import near_pairs, spelling_variants, variants, word_counts

from .conftest import rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_counts(table, least, every):
    counts = Counter()
    for r in table:
        for run in RUN.findall(r["text"] or ""):
            run = run.translate(UPPER)
            h = crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least}


def brute_near(words):
    """All words one edit away, by trying every edit."""
    letters = {c for w in words for c in w}
    near = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = (edits - {w}) & set(words)
    return near


def brute(words, ratio=5):
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def some_words(seed=3, letters="abé", most=9, count=600):
    draw = random.Random(seed)
    found = {"".join(draw.choice(letters) for _ in range(draw.randint(1, most))) for _ in range(count)}
    return {w: 5 ** draw.randint(0, 6) + draw.randint(0, 2) for w in found}


@pytest.mark.parametrize("pairs", [spelling.PAIRS, 20, 0])
def test_near_pairs_are_all_found_once(spark, pairs):
    """Few letters make crowded chunks; small limits refine them to single code points."""
    words = some_words()
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = sorted((r["a"], r["b"]) for r in near_pairs(df, pairs).collect())
    want = {tuple(sorted((w, x), key=lambda y: (len(y), y))) for w, found in brute_near(words).items() for x in found}
    assert got == sorted(want) and len(got) > 600


def test_forms_and_roots(spark):
    words = some_words(9, "abcd", 7, 1_500)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = brute(words)
    assert rows(variants(df), *COLUMNS) == want
    assert any(r[1] != r[2] and r[1] for r in want) and any(r[1] is None and r[4] for r in want)


def test_texts_like_brute_force(documents):
    table = documents.collect()
    for every in (None, 3):
        words = {w: n for w, n in brute_counts(table, 4, every).items() if n >= 2}
        assert rows(spelling_variants(documents.withColumn("word", documents["text"]), least=4, often=2, every=every), *COLUMNS) == brute(words)


def test_runs_end_at_other_letters(spark, monkeypatch):
    texts = ["ÉcoleŁécole ×÷ÿĀ Straße’s naïve_naïve ſtop", None, "", "Z" * 3_000_000 + " éa " * 400_000]
    df = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(spelling, "HELD", 2)
    for every in (None, 2):
        got = {r["word"]: r["n"] for r in word_counts(df, least=2, every=every).collect()}
        assert got == brute_counts([{"doc_id": i, "text": t} for i, t in enumerate(texts)], 2, every)


def test_chains_are_followed_to_the_end(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(21)]
    df = spark.createDataFrame(links, "word string, root string")
    assert {r["root"] for r in spelling.followed(df).collect()} == {"w21"}


def test_empty_tables_and_small_ratios(spark, nothing):
    assert spelling_variants(nothing).collect() == []
    with pytest.raises(ValueError):
        variants(spark.createDataFrame([("abc", 1)], "word string, n bigint"), ratio=1)

import re
from collections import Counter, defaultdict

import pytest

from specflow.llm import divergence
from specflow.llm.divergence import audit, term_counts

from .conftest import rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(table, least, top):
    docs = [(r["lang"] or "", r["source"] or "", TERM.findall((r["text"] or "").translate(UPPER))) for r in table]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())

        def p(count):
            total = sum(count.values())
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for source, mine in shares.items():
            others = [(o, sum((mine[t] - x[t]) ** 2 // (mine[t] + x[t]) for t in kept)) for o, x in shares.items() if o != source]
            more = [(t, (mine[t] - q[t]) ** 2 // (mine[t] + q[t])) for t in kept if counts[source][t] and mine[t] > q[t]]
            for part, found in (("pair", others), ("term", more)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, *x, i + 1) for i, x in enumerate(ranked[: top if part == "term" else None])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("span, groups", [(1_024, 16), (100, 1), (70, 2)])
def test_like_brute_force(documents, monkeypatch, span, groups):
    """Small blocks and chunks: many tasks share the work."""
    monkeypatch.setattr(divergence, "SPAN", span)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    got = rows(audit(documents.withColumn("block", documents["doc_id"]), least=2, top=7), *COLUMNS)
    assert got == brute(documents.collect(), 2, 7)
    assert len({r[1] for r in got if r[0] == "en"}) == 4


def test_nulls_ties_and_sources_without_terms(spark):
    table = [("x y", "en", "a"), ("x x X y", "en", "b"), (None, "en", "c"), ("!", "en", None), ("É é", None, "a"), ("É é", None, "a"), ("once", "fr", "a"), ("", "fr", "b")]
    df = spark.createDataFrame(table, "body string, tongue string, site string")
    got = rows(audit(df, "body", "tongue", "site", least=2, top=1), *COLUMNS)
    assert got == brute([dict(zip(("text", "lang", "source"), r)) for r in table], 2, 1)
    assert ("fr", "a", "pair", "b", 0, 1) in got
    assert [r[3] for r in got if r[:3] == ("en", "b", "pair")] == ["", "a", "c"]


def test_large_counts_stay_exact(spark):
    share = divergence.share
    df = spark.createDataFrame([(4 * 10**12, 10**13, 10**9), (0, 0, 1)], "n bigint, t bigint, v bigint")
    got = df.select(share(df["n"], df["t"], df["v"]).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (4 * 10**12 + 2) // (10**13 + 2 * 10**9), 10**9 + 1]


def test_long_texts_and_full_counters_hand_on(spark, monkeypatch):
    text = "Aa b " * 300_000 + "x" * 2_000_000 + " aa"
    df = spark.createDataFrame([("en", "s", text), ("en", "s", "aa")], "lang string, source string, text string").coalesce(1)
    monkeypatch.setattr(divergence, "HELD", 1)
    got = {r["term"]: (r["n"], r["docs"]) for r in term_counts(df).collect()}
    assert got == {"aa": (300_002, 2), "b": (300_000, 1), "x" * 2_000_000: (1, 1)}


def test_empty_table(nothing):
    assert audit(nothing).collect() == []

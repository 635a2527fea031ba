from collections import defaultdict

from specflow.llm.line_dedup import drop_shared_lines

from .conftest import rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(table, documents, least):
    where = defaultdict(set)
    for r in table:
        for line in (r["text"] or "").split("\n"):
            where[key(line)].add(r["doc_id"])
    shared = {k for k, ids in where.items() if len(k) >= least and len(ids) >= documents}
    out = []
    for r in table:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if key(x) not in shared]
        out.append((r["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_like_brute_force(documents):
    table = documents.collect()
    for least, broadcast_keys in ((1, 200_000), (5, 0), (1, 0)):
        got = drop_shared_lines(documents, documents=10, least=least, broadcast_keys=broadcast_keys)
        assert rows(got, "doc_id", "n_lines", "n_dropped", "text") == brute(table, 10, least)
    assert sum(r[2] for r in brute(table, 10, 1)) > 20
    assert got.columns[: len(documents.columns)] == documents.columns


def test_code_points_count_and_texts_can_lose_everything(spark):
    df = spark.createDataFrame([(i, "éé\n" * 2 + "ab") for i in range(10)], "doc_id bigint, text string")
    assert {r["text"] for r in drop_shared_lines(df, least=3).collect()} == {"éé\néé\nab"}
    assert {r["text"] for r in drop_shared_lines(df, least=2).collect()} == {""}


def test_empty_table(nothing):
    assert drop_shared_lines(nothing).count() == 0

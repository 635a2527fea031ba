"""Statements and ranges for databases; merges run in an engine inside the test, as no server is at hand."""

import duckdb
import pytest

from specflow.sinks import database
from specflow.sinks.database import bounds, dialect_of, merge_statement, newest, unprocessed_query


@pytest.mark.parametrize("dialect", ["conflict", "merge"])
def test_merges_replace_and_add_by_key(dialect):
    db = duckdb.connect()
    db.execute('CREATE TABLE t ("order" INT, part INT, v VARCHAR, PRIMARY KEY ("order", part))')
    db.execute("INSERT INTO t VALUES (1, 1, 'old'), (1, 2, 'stays')")
    db.execute("CREATE TABLE s AS SELECT * FROM (VALUES (1, 1, 'new'), (2, 1, 'added')) x(\"order\", part, v)")
    db.execute(merge_statement("t", "s", ["order", "part", "v"], ["order", "part"], dialect))
    assert db.execute("SELECT * FROM t ORDER BY ALL").fetchall() == [(1, 1, "new"), (1, 2, "stays"), (2, 1, "added")]


def test_merges_of_keys_alone_and_other_spellings():
    assert merge_statement("t", "s", ["k"], ["k"], "conflict").endswith('ON CONFLICT ("k") DO NOTHING')
    assert merge_statement("t", "s", ["k", "v`"], ["k"], "duplicate") == "INSERT INTO t (`k`, `v```) SELECT `k`, `v``` FROM s ON DUPLICATE KEY UPDATE `v``` = VALUES(`v```)"
    assert "WHEN MATCHED" not in merge_statement("t", "s", ["k"], ["k"])
    assert [dialect_of(f"jdbc:{u}") for u in ("postgresql://h/d", "mysql://h/d", "sqlserver://h")] == ["conflict", "duplicate", "merge"]
    for key in ([], ["other"]):
        with pytest.raises(ValueError):
            merge_statement("t", "s", ["k"], key)


def test_ranges():
    assert bounds(None, None, 0) == {} and bounds(1, 9, 10, 100) == {}
    assert bounds(0, 999, 1_000, 100) == {"lowerBound": "0", "upperBound": "1000", "numPartitions": "10"}
    assert bounds(5, 6, 1_000, 100)["numPartitions"] == "2" and bounds(0, 10**9, 10**12)["numPartitions"] == str(database.MOST_PARTITIONS)


def test_unprocessed_rows():
    db = duckdb.connect()
    db.execute("CREATE TABLE t AS SELECT i AS id FROM range(5) r(i)")
    db.execute("CREATE TABLE m AS SELECT i AS id FROM range(3) r(i)")
    assert sorted(db.execute(unprocessed_query("t", "m", ["id"])).fetchall()) == [(3,), (4,)]


def test_newest_row_per_key(spark):
    rows = [(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (None, 5, "d"), (None, 4, "e"), (2, 1, "f"), (2, 1, "f")]
    df = spark.createDataFrame(rows, "k int, n int, v string")
    assert sorted(map(tuple, newest(df, ["k"], ["n"]).collect()), key=repr) == sorted([(1, 3, "b"), (None, 5, "d"), (2, 1, "f")], key=repr)
    assert newest(df, ["k"], None) is df

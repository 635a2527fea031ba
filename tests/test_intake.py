"""Folders taken in by polls, replaceable windows, commits and digests of files."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from specflow.commits import CommitLog
from specflow.operators.window_store import WindowStore
from specflow.plans import intake
from specflow.sources.listing import archived_copies, stored_at
from specflow.spec import load_spec

SPEC = load_spec({"id": "t", "format": "CSV", "fields": [{"name": "n", "type": "INTEGER", "columnIndex": 0}]})


def gz(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)


def taker(spark, folder, **options):
    return intake.FolderIntake(spark, f"{folder}/in", SPEC, f"{folder}/home", f"{folder}/aside", **options)


def states(one):
    return {os.path.basename(r.remote_file_path): (r.processing_status, r.attempt, r.total_records) for r in one.current().collect()}


def test_bad_files_are_tried_three_times_and_set_aside(spark, folder):
    for i in range(7):
        gz(f"{folder}/in/sub/good{i}.gz", gzip.compress(f"{i}\n{i + 1}\n".encode()))
    whole = gzip.compress(b"1\n" * 100_000)
    gz(f"{folder}/in/cut.gz", whole[: len(whole) // 2])
    gz(f"{folder}/in/none.gz", b"no gzip")
    one = taker(spark, folder, after="ARCHIVE", archive=f"{folder}/done", per_poll=5)
    assert one.run() >= 4
    got = states(one)
    assert {got.pop(n)[:2] for n in ("cut.gz", "none.gz")} == {("FAILED", 3)}
    assert set(got.values()) == {("PROCESSED", 1, 2)} and len(got) == 7
    errors = {os.path.basename(r.remote_file_path): r.error for r in one.current().filter("error is not null").collect()}
    assert set(errors) == {"cut.gz", "none.gz"} and all(errors.values())
    assert sorted(os.listdir(f"{folder}/aside")) == ["cut.gz", "none.gz"]
    assert len([n for n in os.listdir(f"{folder}/done/sub") if not n.startswith(".")]) == 7 and not os.listdir(f"{folder}/in/sub")
    assert spark.read.parquet(f"{folder}/home/events/poll=*").count() == 14


def test_a_file_that_is_mended_is_taken_in(spark, folder):
    gz(f"{folder}/in/a.gz", b"not yet")
    one = taker(spark, folder)
    assert one.poll() == 1 and states(one) == {"a.gz": ("RETRY", 1, None)}
    gz(f"{folder}/in/a.gz", gzip.compress(b"5\n"))
    assert one.poll() == 1 and states(one) == {"a.gz": ("PROCESSED", 2, 1)}
    assert one.poll() == 0 and os.path.exists(f"{folder}/in/a.gz")


def test_a_poll_that_breaks_off_is_done_again(spark, folder, monkeypatch):
    gz(f"{folder}/in/a", b"1\n2\n")
    one = taker(spark, folder, after="DELETE")
    monkeypatch.setattr(one.log, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        one.poll()
    assert one.current().count() == 0 and os.path.exists(f"{folder}/in/a")
    again = taker(spark, folder, after="DELETE")
    assert again.poll() == 1 and states(again) == {"a": ("PROCESSED", 1, 2)} and not os.path.exists(f"{folder}/in/a")


def test_empty_files_get_an_outcome(spark, folder):
    gz(f"{folder}/in/empty", b"\n \n")
    gz(f"{folder}/in/full", b"1\n")
    one = taker(spark, folder)
    one.run()
    assert states(one) == {"empty": ("PROCESSED", 1, 0), "full": ("PROCESSED", 1, 1)}


def test_treatments_are_checked(spark, folder):
    with pytest.raises(ValueError):
        taker(spark, folder, after="BURN")
    with pytest.raises(ValueError):
        taker(spark, folder, after="MOVE")


def test_halving_finds_exactly_the_bad_ones():
    from pyspark.errors import PySparkException

    calls = []

    def read(some):
        calls.append(len(some))
        if {"f3", "f11"} & set(some):
            raise PySparkException("java.io.IOException: broken")

    assert set(intake.unreadable([f"f{i}" for i in range(16)], read)) == {"f3", "f11"}
    assert intake.unreadable([], read) == {} and len(calls) < 20


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "day string, k string, n bigint")


def test_replacing_a_window_leaves_the_others_as_they_are(spark, folder):
    store = WindowStore(spark, folder, "day")
    first = store.publish(rows_of(spark, ("2024-01-01", "a", 1), ("2024-01-02", "a", 2), ("2024-01-02", "b", 3), ("007", "c", 4)))
    files = {p: open(p, "rb").read() for d, _, names in os.walk(f"{folder}/rows") for p in (f"{d}/{n}" for n in names)}
    reader = store.read(first)
    second = store.replace("2024-01-02", rows_of(spark, ("2024-01-02", "z", 9)))
    third = store.replace("007", rows_of(spark))
    show = lambda df: sorted((r.day, r.k, r.n) for r in df.collect())
    assert show(reader) == show(store.read(first)) == [("007", "c", 4), ("2024-01-01", "a", 1), ("2024-01-02", "a", 2), ("2024-01-02", "b", 3)]
    assert show(store.read(second)) == [("007", "c", 4), ("2024-01-01", "a", 1), ("2024-01-02", "z", 9)]
    assert show(store.read()) == show(store.read(third)) == [("2024-01-01", "a", 1), ("2024-01-02", "z", 9)]
    assert all(open(p, "rb").read() == data for p, data in files.items())


def test_windows_that_look_like_numbers_or_have_no_name(spark, folder):
    store = WindowStore(spark, folder, "day")
    store.publish(rows_of(spark, ("007", "a", 1), ("7", "b", 2), (None, "c", 3), ("a/b=c %", "d", 4)))
    store.replace("7", rows_of(spark, ("7", "e", 5)))
    store.replace(None, rows_of(spark, (None, "f", 6)))
    store.replace("a/b=c %", rows_of(spark, ("a/b=c %", "g", 7)))
    assert sorted((r.k, r.n) for r in store.read().collect()) == [("a", 1), ("e", 5), ("f", 6), ("g", 7)]


def test_a_failed_replacement_changes_nothing(spark, folder, monkeypatch):
    store = WindowStore(spark, folder, "day")
    store.publish(rows_of(spark, ("d", "a", 1)))
    bad = rows_of(spark, ("d", "a", 5)).withColumn("n", F.when(F.col("n") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("bigint"))
    with pytest.raises(Exception):
        store.replace("d", bad)
    with pytest.raises(ValueError):
        store.replace("d", rows_of(spark, ("e", "a", 5)))
    assert store.version() == 0 and store.read().first().n == 1


def test_replacements_at_the_same_time_are_both_kept(spark, folder, monkeypatch):
    store, other = WindowStore(spark, folder, "day"), WindowStore(spark, folder, "day")
    store.publish(rows_of(spark, ("d", "a", 1), ("e", "a", 2)))
    commit = store.log.commit

    def late(number, entry):
        if other.version() == 0:
            other.replace("e", rows_of(spark, ("e", "b", 3)))
        return commit(number, entry)

    monkeypatch.setattr(store.log, "commit", late)
    assert store.replace("d", rows_of(spark, ("d", "c", 4))) == 2
    assert sorted((r.day, r.k, r.n) for r in store.read().collect()) == [("d", "c", 4), ("e", "b", 3)]


def test_a_number_is_committed_once(spark, folder):
    log = CommitLog(spark, folder)
    assert log.newest() == -1 and log.commit(0, {"a": 1}) and not log.commit(0, {"a": 2})
    assert CommitLog(spark, folder).entry(0) == {"a": 1} and log.newest() == 0


def parts_etag(data, size):
    sums = [hashlib.md5(data[i : i + size]) for i in range(0, len(data), size)] or [hashlib.md5(b"")]
    return sums[0].hexdigest() if len(sums) == 1 else f"{hashlib.md5(b''.join(s.digest() for s in sums)).hexdigest()}-{len(sums)}"


@pytest.mark.parametrize("part", [100, 1_000, 1 << 20])
def test_digests_in_parts(spark, folder, part):
    files = {
        "plain.txt": b"line\n" * 700, "open.txt": b"a\nb" * 300, "crlf.txt": b"x\r\ny\r\n\r\n" * 90, "marked.txt": b"\xef\xbb\xbfabc\n" * 80,
        "long.txt": bytes(range(256)) * 30, "one.txt": b"\n", "edge.txt": b"y" * 99 + b"\n" + b"z" * 200,
        "spaced + [name].txt": b"q\n" * 40}
    os.makedirs(f"{folder}/in/deep")
    for name, data in files.items():
        with open(f"{folder}/in/deep/{name}", "wb") as out:
            out.write(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r.remote_file_name: r for r in archived_copies(spark, f"{folder}/in", part_bytes=part).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {n: (r.etag, r.file_size_bytes) for n, r in got.items()} == {n: (parts_etag(d, part), len(d)) for n, d in files.items()}
    assert all(r.bucket == "" and r.key.startswith(folder.lstrip("/")) for r in got.values())


def test_places_in_stores(spark):
    df = spark.createDataFrame([("s3a://inbox/2024/a b.csv",), ("file:///tmp/x",), ("/tmp/x",), ("hdfs://host:8020/k/f",)], "p string")
    assert [(r.o.bucket, r.o.key) for r in df.select(stored_at(F.col("p")).alias("o")).collect()] == [
        ("inbox", "2024/a b.csv"), ("", "tmp/x"), ("", "tmp/x"), ("host:8020", "k/f")]


def test_a_backlog_is_dealt_over_few_polls(spark, folder, monkeypatch):
    """Each poll costs the same jobs, so the number of polls must not grow with the files that wait."""
    from specflow.streaming import sources

    monkeypatch.setattr(sources, "BACKLOG_POLLS", 3)
    for i in range(12):
        gz(f"{folder}/in/f{i}.gz", gzip.compress(f"{i}\n".encode()) if i else b"no gzip")
    one = taker(spark, folder, per_poll=2, after="ARCHIVE", archive=f"{folder}/done")
    # four files a poll; the one that cannot be read is among the oldest three times
    assert one.run() == 4
    got = states(one)
    assert got.pop("f0.gz")[:2] == ("FAILED", 3) and set(got.values()) == {("PROCESSED", 1, 1)} and len(got) == 11
    assert sources.poll_size(20, 50) == 20 and sources.poll_size(20, 90) == 30 and sources.poll_size(20, 10**9) == sources.MOST_FILES

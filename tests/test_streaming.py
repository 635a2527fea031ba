import os

import pytest
from pyspark.sql import functions as F

from specflow.operators import windows as batch
from specflow.session import work_path
from specflow.streaming import book, intake, keyed, late, runs, sources, windows
from specflow.spec import load_spec


def arrivals(spark, folder, batches):
    """One parquet file per batch, oldest first."""
    for i, rows in enumerate(batches):
        path = f"{folder}/in/b{i}"
        spark.createDataFrame(rows, "k string, id int, kind string, s long").coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    schema = "k string, id int, kind string, s long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in/*").withColumn("ts", F.timestamp_seconds("s"))


def test_keyed_windows_carry_over_batches_and_snapshots(spark, folder, monkeypatch):
    monkeypatch.setattr(keyed, "SNAPSHOT_EVERY", 2)
    batches = [[("a" if i % 4 else "b", 100 * n + i, "close" if i % 3 == 0 else "x", n) for i in range(7)] for n in range(5)]
    out = f"{folder}/out"
    runs.run_each(arrivals(spark, folder, batches), keyed.count_windows(("k",), ("id",), 4, f"{folder}/state", out), f"{folder}/cp")
    got = {r.id: r.window_no for r in spark.read.parquet(f"{out}/batch_no=*").collect()}
    marked = f"{folder}/marked"
    runs.run_each(arrivals(spark, f"{folder}/again", batches), keyed.marker_windows(("k",), ("id",), F.col("kind") == "close", f"{folder}/state2", marked), f"{folder}/cp2")
    closes = {r.id: r.window_no for r in spark.read.parquet(f"{marked}/batch_no=*").collect()}
    seen, closed = {}, {}
    for rows in batches:
        for k, i, kind, _ in rows:
            assert got[i] == seen.get(k, 0) // 4
            assert closes[i] == closed.get(k, 0)
            seen[k] = seen.get(k, 0) + 1
            closed[k] = closed.get(k, 0) + (kind == "close")


def test_late_events_are_dropped(spark, folder):
    # lateness is judged by the watermark of the batch before, so the late event comes two batches on
    batches = [[("a", 1, "x", 1000), ("a", 2, "x", 5000)], [("a", 7, "x", 5002)], [("a", 3, "x", 1001)], [("a", 4, "x", 5001), ("a", 5, "x", 9000)], [("a", 6, "x", 20000)]]
    stream = arrivals(spark, folder, batches).withWatermark("ts", "60 seconds")
    done = runs.run_to_folder(windows.windowed_counts(stream, "ts", "100 seconds"), "late")
    counts = {int(r.window_start.timestamp()): r.event_count for r in done.collect()}
    assert counts[1000] == 1 and counts[5000] == 3 and counts[9000] == 1


def test_stream_dedup(spark, folder):
    batches = [[("a", 1, "x", 10), ("a", 2, "x", 11)], [("a", 3, "x", 12), ("b", 4, "x", 13)]]
    stream = arrivals(spark, folder, batches).withWatermark("ts", "1 hour")
    assert sorted(r.k for r in runs.run_to_folder(windows.deduplicated(stream, ["k"]), "dedup").collect()) == ["a", "b"]


def test_stream_windows_equal_batch_windows(spark, folder):
    batches = [[("a", i, "x", i * 37) for i in range(40)]]
    stream = arrivals(spark, folder, batches)
    streamed = runs.run_to_folder(windows.windowed_counts(stream.withWatermark("ts", "1 hour"), "ts", "300 seconds"), "win", "complete")
    frame = spark.createDataFrame(batches[0], "k string, id int, kind string, s long").withColumn("ts", F.timestamp_seconds("s"))
    whole = batch.time_windows(frame, "ts", "300 seconds")
    assert sorted(map(tuple, streamed.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


SPEC = load_spec({"id": "s", "format": "CSV", "hasHeader": True, "fields": [{"name": "id", "type": "INTEGER", "columnName": "id"}],
                  "validationRules": [{"ruleId": "r", "field": "id", "ruleType": "MIN_VALUE", "value": "2", "severity": "FATAL", "message": "low"}]})


def test_folder_to_events_and_archive(spark, folder):
    os.makedirs(f"{folder}/in")
    for name in ("a", "b"):
        with open(f"{folder}/in/{name}.csv", "w") as out:
            out.write("id\n1\n\n2\n3\n")
    out = work_path(spark, "t-events")
    files = sources.poll_files(spark, f"{folder}/in", after="ARCHIVE", archive_dir=f"{folder}/done", files_per_poll=1)
    runs.run_each(files, intake.event_writer(SPEC, out, "run"), f"{folder}/cp")
    events = spark.read.parquet(f"{out}/events/batch_no=*")
    assert events.count() == 4
    assert spark.read.parquet(f"{out}/quarantine/batch_no=*").count() == 2
    assert sorted(r.total_records for r in spark.read.parquet(f"{out}/summary/batch_no=*").collect()) == [3, 3]


def put_files(folder, *names):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        with open(f"{folder}/{name}", "w") as out:
            out.write("x\ny\n")


def test_ledger_stream_takes_a_file_once(spark, folder):
    home = f"{folder}/book"

    def take(stream):
        runs.run_each(sources.poll_lines(spark, f"{folder}/in"), book.ledger_writer(home, 1, stream), f"{folder}/cp-{stream}")

    for name in ("a", "b", "c"):
        put_files(f"{folder}/in", name)
        take("one")
    take("one")
    rows = book.read_book(spark, home).collect()
    assert sorted((r.remote_file_name[-1], r.n_lines) for r in rows) == [("a", 2), ("b", 2), ("c", 2)]
    # a second stream with its own checkpoint finds all of them taken and leaves the first one's rows
    put_files(f"{folder}/in", "d")
    take("two")
    rows = book.read_book(spark, home).collect()
    assert sorted((r.remote_file_name[-1], r.stream) for r in rows) == [("a", "one"), ("b", "one"), ("c", "one"), ("d", "two")]


def listing(spark, *names):
    rows = [(1, n, 2, "PENDING") for n in sorted(set(names))]
    return spark.createDataFrame(rows, "integration_id bigint, remote_file_name string, n_lines bigint, processing_status string")


def test_books_are_compacted_and_reads_are_bounded(spark, folder, monkeypatch):
    monkeypatch.setattr(book, "SNAPSHOT_EVERY", 3)
    ledger = book.Book(spark, folder)
    read = [ledger.add(listing(spark, f"f{i}", f"f{i // 2}", "same"), "s", i) for i in range(9)]
    assert max(read) <= 3
    assert sorted(r.remote_file_name for r in ledger.read().collect()) == sorted({"same", *(f"f{i}" for i in range(9))})
    # a batch that runs again after its commit changes nothing
    before = ledger.log.newest()
    ledger.add(listing(spark, "other"), "s", 5)
    assert ledger.log.newest() == before


def test_two_writers_that_find_the_same_file_new(spark, folder, monkeypatch):
    """The second one commits while the first is about to; the first looks again."""
    first, second = book.Book(spark, folder), book.Book(spark, folder)
    commit = first.log.commit

    def late(number, entry):
        if second.log.newest() < 0:
            second.add(listing(spark, "a", "b"), "two", 0)
        return commit(number, entry)

    monkeypatch.setattr(first.log, "commit", late)
    first.add(listing(spark, "a", "c"), "one", 0)
    assert sorted((r.remote_file_name, r.stream) for r in first.read().collect()) == [("a", "two"), ("b", "two"), ("c", "one")]


def test_late_events_are_kept_aside_and_a_batch_that_runs_again_agrees(spark, folder):
    batches = [[("a", 1, "x", 1_000), ("a", 2, "x", 5_000)], [("a", 3, "x", 4_950), ("a", 4, "x", 1_001), ("a", 5, "x", 4_799)], [], [("b", 6, "x", 9_000), ("b", 7, "x", 100)], [("b", 8, "x", 8_999)]]
    close = F.window("ts", "100 seconds")["end"]
    each = late.late_writer("ts", close, f"{folder}/late", True, 100_000)
    frames = [spark.createDataFrame(rows, "k string, id int, kind string, s long").withColumn("ts", F.timestamp_seconds("s")) for rows in batches]

    def verdicts():
        got = {}
        for kind, column in (("accepted", "verdict"), ("rejected", "reason")):
            got |= {r.id: r[column] for r in late.side(f"{folder}/late", frames[0], kind).collect()}
        return got

    for number, frame in enumerate(frames):
        each(frame, number)
    # marks before the batches: none, 5000, 5000, 5000, 9000
    want = {1: "ON_TIME", 2: "ON_TIME", 3: "LATE", 4: "WINDOW_CLOSED", 5: "WINDOW_CLOSED", 6: "ON_TIME", 7: "WINDOW_CLOSED", 8: "LATE"}
    assert verdicts() == want
    for number in (3, 1, 4):
        each(frames[number], number)
    assert verdicts() == want


def test_runs_that_should_be_whole_fail_when_rows_are_dropped(spark, folder):
    batches = [[("a", 1, "x", 1000), ("a", 2, "x", 5000)], [("a", 7, "x", 5002)], [("a", 3, "x", 1001)], [("a", 6, "x", 20000)]]
    stream = arrivals(spark, folder, batches).withWatermark("ts", "60 seconds")
    with pytest.raises(runs.LateRowsDropped, match="1 rows"):
        runs.run_to_folder(windows.windowed_counts(stream, "ts", "100 seconds"), "late", whole=True)


def test_complete_mode_keeps_the_last_state(spark, folder):
    batches = [[("a", n * 10 + i, "x", n * 40 + i) for i in range(5)] for n in range(4)]
    stream = arrivals(spark, folder, batches).withWatermark("ts", "1 hour")
    done = runs.run_to_folder(windows.windowed_counts(stream, "ts", "100 seconds"), "complete", "complete")
    assert sorted((int(r.window_start.timestamp()), r.event_count) for r in done.collect()) == [(0, 15), (100, 5)]


def test_streams_deal_a_backlog_over_few_polls(spark, folder, monkeypatch):
    monkeypatch.setattr(sources, "BACKLOG_POLLS", 3)
    put_files(f"{folder}/in", *[f"f{i}" for i in range(12)])
    batches = []

    def each(batch, number):
        batches.append(batch.select("_file").distinct().count())

    runs.run_each(sources.poll_lines(spark, f"{folder}/in", files_per_poll=2), each, f"{folder}/cp")
    assert batches == [4, 4, 4]

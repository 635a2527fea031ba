import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from specflow.functions import cron
from specflow.functions.templates import render
from specflow.operators import actions, ledger, logs, metrics, ordered, reconcile, revisions, traces, windows
from specflow.operators.dedup import checksum, first_seen, judged


@pytest.fixture
def skewed(spark):
    """One group holds most rows; a group key may be null."""
    rng = random.Random(3)
    rows = [((["hot"] * 8 + ["a", None])[rng.randrange(10)], rng.randrange(1000), i, rng.randrange(-5, 9)) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, t int, id int, v int").repartition(6)


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("group", [("g",), ()])
def test_chunked_running_sum_equals_the_plain_window(skewed, group):
    value = F.when(F.col("v") != 0, F.col("v"))
    split = ordered.running_sum(skewed, group, ("t", "id"), value, "s", split=True)
    if group:
        same(split, ordered.running_sum(skewed, group, ("t", "id"), value, "s", split=False))
    else:
        got = {r.id: r.s for r in split.collect()}
        total = None
        for r in sorted(skewed.collect(), key=lambda r: (r.t, r.id)):
            total = total if r.v == 0 else (total or 0) + r.v
            assert got[r.id] == total


def test_chunked_previous_and_islands(skewed):
    cols = {"p": F.col("v"), "q": F.col("t")}
    same(ordered.previous(skewed, ("g",), ("t", "id"), cols, split=True), ordered.previous(skewed, ("g",), ("t", "id"), cols, split=False))
    on = F.col("v") > 0
    same(ordered.islands(skewed, ("g",), ("t", "id"), on, split=True), ordered.islands(skewed, ("g",), ("t", "id"), on, split=False))


def test_group_size_decides(spark, skewed):
    spark.conf.set(ordered.LIMIT_KEY, "100")
    try:
        assert "_chunk" not in ordered.row_numbers(skewed, ("g",), ("t", "id")).columns
        same(ordered.row_numbers(skewed, ("g",), ("t", "id")), ordered.row_numbers(skewed, ("g",), ("t", "id"), split=False))
    finally:
        spark.conf.unset(ordered.LIMIT_KEY)
    assert ordered.measure(skewed, ("g",))[1] == 3000


def test_dedup_of_one_hot_checksum(spark):
    rows = [(i, i % 97, "same" if i % 3 else f"u{i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "id int, t int, p string").withColumn("sum", checksum("p"))
    done = judged(frame, ["sum"], ["t", "id"], "id").collect()
    kept = [r.id for r in done if r.accepted]
    assert len(done) == 600 and len(kept) == 201
    assert min((r.t, r.id) for r in done if r.p == "same") == next((r.t, r.id) for r in done if r.accepted and r.p == "same")
    assert all(r.reason == "DUPLICATE_CHECKSUM" for r in done if not r.accepted)
    assert first_seen(frame, ["sum"], ["t", "id"]).count() == 201


def pairs(spark, *cron_and_range, **options):
    rows = windows.instances(spark, *cron_and_range, **options).orderBy("instance_id").collect()
    assert [r.instance_id for r in rows] == list(range(len(rows)))
    return [(r.opened_at, r.closed_at) for r in rows]


def test_windows_over_midnight_and_over_the_year(spark):
    night = pairs(spark, "0 0 22 * * ?", "0 0 6 * * ?", datetime(2024, 5, 1), datetime(2024, 5, 2))
    assert [(o.day, o.hour, c.day, c.hour) for o, c in night] == [(30, 22, 1, 6), (1, 22, 2, 6)]
    year = pairs(spark, "0 0 0 1 JAN ?", "0 0 0 31 DEC ?", datetime(2024, 2, 1), datetime(2024, 3, 1))
    assert [(o.month, o.day, c.month, c.day) for o, c in year] == [(1, 1, 12, 31)]
    leap = pairs(spark, "0 0 0 29 FEB ?", "0 0 12 29 FEB ?", datetime(2025, 1, 1), datetime(2028, 3, 1))
    assert [(o.year, c.hour) for o, c in leap] == [(2028, 12)]
    assert pairs(spark, "0 0 0 30 FEB ?", "0 0 1 * * ?", datetime(2024, 1, 1), datetime(2024, 12, 31)) == []
    assert pairs(spark, "0 0 8 * * ?", "0 0 0 30 FEB ?", datetime(2024, 1, 1), datetime(2024, 1, 3)) == []
    capped = pairs(spark, "0 0 22 * * ?", "0 0 6 * * ?", datetime(2024, 5, 1), datetime(2024, 5, 2), cap_minutes=60)
    assert [o.day for o, _ in capped] == [1]


def plain_pairs(open_cron, close_cron, start, end, timezone):
    """Every opening with the next closing, by walking through all instants."""
    opening, closing = cron.Schedule(open_cron, timezone), cron.Schedule(close_cron, timezone)
    start, end = start.replace(tzinfo=UTC), end.replace(tzinfo=UTC)
    wide = (start - timedelta(days=40), end + timedelta(days=40))
    closes, found = closing.between(*wide), []
    for opened in opening.between(*wide):
        closed = next((c for c in closes if c > opened), None)
        if closed and opened < end and closed > start:
            found.append((opened.replace(tzinfo=None), closed.replace(tzinfo=None)))
    return found


@pytest.mark.parametrize("opens, closes, zone", [
    ("0 0/20 * * * ?", "0 10/20 * * * ?", "America/New_York"), ("0 30 1,2,3 * * ?", "0 15 2-4 * * ?", "Europe/Berlin"), ("0 0 8 * * MON-FRI ?", "0 0 8 * * SAT ?", "Asia/Tokyo"),
    ("0 0 0 L * ?", "0 0 12 1,15 * ?", "UTC"), ("*/7 59 23 * * ?", "0 0 0 * * ?", "Australia/Lord_Howe")])
def test_instances_like_plain_walks_over_changing_clocks(spark, opens, closes, zone):
    for start, end in ((datetime(2024, 3, 8), datetime(2024, 4, 2)), (datetime(2024, 10, 26), datetime(2024, 11, 5))):
        assert pairs(spark, opens, closes, start, end, zone) == plain_pairs(opens, closes, start, end, zone)


def test_a_window_every_second_of_many_days(spark):
    frame = windows.instances(spark, "* * * * * ?", "0 * * * * ?", datetime(2024, 1, 1), datetime(2024, 1, 31))
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_seconds("closed_at") - F.unix_seconds("opened_at")).alias("longest"), F.max("instance_id").alias("last")).first()
    # those of the minute before the range are closed at its start
    assert (row["n"], row["longest"], row["last"]) == (30 * 86_400, 60, 30 * 86_400 - 1)


def test_events_meet_windows_of_all_lengths(spark):
    frame = spark.createDataFrame([(i, i * 10, i * 10 + 10 ** (i % 7)) for i in range(200)], "instance_id int, a long, b long").select(
        "instance_id", F.timestamp_seconds("a").alias("opened_at"), F.timestamp_seconds("b").alias("closed_at"))
    events = spark.range(0, 2500, 3).select("id", F.timestamp_seconds("id").alias("ts"))
    got = sorted((r.id, r.instance_id) for r in windows.assign(events, "ts", frame).collect())
    assert got == [(t, i) for t in range(0, 2500, 3) for i in range(200) if i * 10 <= t < i * 10 + 10 ** (i % 7)]


def test_deep_chains_and_rings(spark):
    from specflow.operators import traces

    spans = [("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(131)]
    spans += [("r", "a", "b"), ("r", "b", "a"), ("r", "c", "a"), ("r", "d", "gone"), ("t", "x", "s64"), ("u", "s0", None), ("u", "s1", "s0")]
    frame = spark.createDataFrame(spans, "trace_id string, span_id string, parent_id string")
    got = {(r.trace_id, r.span_id): r.depth for r in traces.with_depth(frame).collect()}
    assert [got["t", f"s{i}"] for i in range(131)] == list(range(131))
    assert got["t", "x"] == 65 and got["u", "s1"] == 1
    assert {got["r", s] for s in "abcd"} == {None}


@pytest.mark.parametrize("value, bound, order", [
    ("0.009999999999", "0.01", -1), ("0.00000000001", "0", 1), ("-0.00000000001", "0", -1), ("1E-20", "0", 1), ("1e3", "1000", 0), ("+1000.000", "1000", 0),
    ("123456789012345678901234567890123456789", "123456789012345678901234567890123456788", 1), ("-5", "-4.99", -1), ("-0.0", "0", 0), ("0e9", "0", 0),
    (".5", "0.5", 0), ("5.", "5", 0), ("99999999999999999999999999999", "1", 1), ("-99999999999999999999999999999.5", "1", -1), ("12", "123", -1), ("1.5E+1", "15", 0)])
def test_exact_comparison(spark, value, bound, order):
    from specflow.functions import text

    frame = spark.createDataFrame([(value,)], "v string")
    row = frame.select(*[text.compare_number(F.col("v"), op, bound).alias(str(i)) for i, op in enumerate(("<", "<=", ">", ">="))]).first()
    assert tuple(row) == (order < 0, order <= 0, order > 0, order >= 0)


@pytest.mark.parametrize("value, plain", [
    ("1E-20", "0.00000000000000000001"), ("1.2345678901234567891234E0", "1.2345678901234567891234"), ("-2.50e2", "-250"), ("7e0", "7"), ("0E5", "0"),
    ("12.5E-1", "1.25"), ("1e40", "1" + "0" * 40), ("1e999999", "1e999999"), ("+007.10", "7.10"), (".5", "0.5"), ("5.", "5")])
def test_plain_notation(spark, value, plain):
    from specflow.functions import text

    assert spark.createDataFrame([(value,)], "v string").select(text.decimal_text(F.col("v")).alias("o")).first().o == plain


def test_cron():
    day = (datetime(2024, 3, 8), datetime(2024, 3, 12))
    fires = cron.fire_times("0 0 8 * * MON-FRI ?", *day, timezone="America/New_York")
    # clocks change on 10 March: 13:00 UTC before, 12:00 UTC after
    assert [(f.day, f.hour) for f in fires] == [(8, 13), (11, 12)]
    assert len(cron.fire_times("0 0/30 * * * ?", datetime(2024, 1, 1), datetime(2024, 1, 2))) == 48
    assert [f.minute for f in cron.fire_times("0 29/30 * * * ?", datetime(2024, 1, 1), datetime(2024, 1, 1, 1))] == [29, 59]
    assert [f.day for f in cron.fire_times("0 59 23 L * ?", datetime(2024, 2, 1), datetime(2024, 4, 1))] == [29, 31]
    assert len(cron.fire_times("*/15 8-9 * * 1-5", datetime(2024, 1, 1), datetime(2024, 1, 8))) == 40
    assert [f.month for f in cron.fire_times("0 0 0 1 JAN,JUL ?", datetime(2024, 1, 1), datetime(2025, 1, 1))] == [1, 7]
    with pytest.raises(ValueError):
        cron.fire_times("0 0", *day)


def test_threshold(spark):
    frame = spark.range(25).select(F.lit("w").alias("w"), F.col("id"))
    fires = lambda **k: [r.running_count for r in windows.threshold_fires(frame, ("w",), ("id",), 10, **k).orderBy("id").collect()]
    assert fires() == [10, 20] and fires(reset=False) == [10] and fires(limit=1) == [10]


def test_arrival(spark):
    frame = spark.sql("select timestamp'2024-01-01 10:00:00' close, explode(array(timestamp'2024-01-01 09:59:59', timestamp'2024-01-01 10:00:05', timestamp'2024-01-01 10:00:06')) a")
    judge = lambda allow: [r.v for r in frame.select(windows.arrival_verdict(F.col("a"), F.col("close"), allow, 5000).alias("v")).collect()]
    assert judge(True) == ["ON_TIME", "LATE", "WINDOW_CLOSED"] and judge(False) == ["ON_TIME", "WINDOW_CLOSED", "WINDOW_CLOSED"]


def test_states(spark):
    assert [r.ok for r in spark.createDataFrame([("PENDING", "OPENING"), ("OPEN", "CLOSED"), ("CLOSED", "OPEN")], "a string, b string")
            .select(windows.transition_allowed(F.col("a"), F.col("b")).alias("ok")).collect()] == [True, False, False]
    assert spark.range(1).select(ledger.move_allowed(F.lit("PROCESSING"), F.lit("FAILED")).alias("x")).first().x


@pytest.mark.parametrize("absolute, percent, expected, actual, good", [
    (0, 0.0, 10, 10, True), (0, 0.0, 10, 11, False), (1, 0.0, 10, 11, True), (0, 0.5, 1000, 995, True), (0, 0.5, 1000, 994, False), (0, 0.0, 0, 0, True)])
def test_tolerance(spark, absolute, percent, expected, actual, good):
    frame = spark.createDataFrame([(expected, actual)], "expected_count bigint, actual_count bigint")
    assert (reconcile.verdict(frame, "FAIL_WINDOW", absolute, percent).first().verdict == "PASS") is good


def test_counter_restart(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([5, 8, 2, 3])], "id int, v int").withColumn("ts", F.timestamp_seconds("id")).withColumn("s", F.lit("x"))
    assert metrics.increase(frame, ("s",), "ts", "id", "v", 60).first().increase == 3 + 2 + 1


def test_quantiles(spark):
    frame = spark.createDataFrame([("k", float(v)) for v in range(1, 101)], "k string, v double")
    done = metrics.percentiles(frame, ["k"], "v", {"p50": 0.5, "p99": 0.99}, split=True).first()
    assert (done.p50, done.p99, done.n) == (50.0, 99.0, 100)
    buckets = metrics.bucketed(frame, ["k"], F.col("v"), [10.0, 50.0, 90.0])
    assert metrics.histogram_quantile(buckets, ["k"], 0.3).first().quantile == pytest.approx(30.0)
    assert metrics.histogram_quantile(buckets, ["k"], 0.05).first().quantile == pytest.approx(5.0)
    assert metrics.histogram_quantile(buckets, ["k"], 0.99).first().quantile == 90.0


def test_near_alerts_against_all_pairs(spark):
    rng = random.Random(5)
    line_at = sorted(rng.randrange(0, 5000) for _ in range(400))
    alert_at = sorted(rng.randrange(0, 5000) for _ in range(25))
    lines = spark.createDataFrame(list(enumerate(line_at)), "id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    alerts = spark.createDataFrame(list(enumerate(alert_at)), "id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    spans = logs.alert_spans(alerts, "ts", "id", 30)
    got = [r.id for r in logs.near_alerts(lines, "ts", spans, 60_000).collect()]
    assert sorted(got) == [i for i, t in enumerate(line_at) if any(abs(t - a) <= 30 for a in alert_at)]
    counts = {r.id: r.n_lines for r in logs.counts_near_alerts(lines, alerts, "ts", "id", 30).collect()}
    assert counts == {i: sum(abs(t - a) <= 30 for t in line_at) for i, a in enumerate(alert_at)}


def test_span_tree(spark):
    rows = [("t", "a", None, "root", 250), ("t", "b", "a", "run", 230), ("t", "c", "b", "parse", 80), ("t", "x", "lost", "odd", 1), ("t", "y", "y", "self", 1)]
    frame = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, operation string, duration_ms int").withColumn("is_error", F.lit(False))
    depth = {r.span_id: r.depth for r in traces.with_depth(frame).collect()}
    assert depth == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}
    top = traces.summary(frame).first()
    assert (top.span_count, top.total_ms, top.slowest_span) == (5, 250, "a")


def test_revisions(spark):
    frame = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "c")], "id string, version int, body string")
    assert {(r.id, r.body) for r in revisions.latest(frame, ["id"], "version").collect()} == {("p", "b"), ("q", "c")}
    back = revisions.rollback(frame, ["id"], "version", 1, ["body"]).filter("id = 'p'").first()
    assert (back.version, back.body, back.restored_from) == (3, "a", 1)
    old, new = frame.filter("version = 1").drop("version"), frame.filter("version = 2").drop("version")
    assert {(r.id, r.change) for r in revisions.diff(old, new, ["id"], "body").collect()} == {("p", "CHANGED"), ("q", "REMOVED")}
    assert [r.id for r in revisions.page_after(frame, "id", "p", 5).collect()] == ["q"]


def test_action_chain(spark):
    rows = [("w", 1, True, False), ("w", 2, False, True), ("w", 3, False, False), ("w", 4, True, False), ("w", 5, False, False)]
    frame = spark.createDataFrame(rows, "w string, no int, succeeded boolean, continue_on_failure boolean")
    done = actions.chain_outcome(frame, ("w",), ("no",)).orderBy("no").collect()
    assert [r.status for r in done] == ["SUCCESS", "FAILED", "FAILED", "SKIPPED", "SKIPPED"]
    assert [r.no for r in done if r.fires_on_error] == [3]


def test_ledger_append(spark):
    listing = spark.createDataFrame([(1, "a", 5), (1, "b", 2), (1, "b", 1), (2, "a", 3)], "integration_id int, remote_file_name string, t int")
    book = spark.createDataFrame([(1, "a", 0, "PROCESSED")], "integration_id int, remote_file_name string, t int, processing_status string")
    done = {(r.integration_id, r.remote_file_name, r.t, r.processing_status) for r in ledger.append(listing, book, ["t"]).collect()}
    assert done == {(1, "a", 0, "PROCESSED"), (1, "b", 1, "PENDING"), (2, "a", 3, "PENDING")}
    assert [r.t for r in ledger.pending(ledger.append(listing, book, ["t"]), 1, ["t"]).collect()] == [1]


def test_templates(spark):
    row = spark.sql("select 7 n, 'ab' s").select(render("9{n:4}|{s:4}|{x}|{s}", {"n": F.col("n"), "s": F.col("s")}, {"n"}).alias("o")).first()
    assert row.o == "90007|ab  |{x}|ab"


def test_depths_over_levels(spark, monkeypatch):
    """A forest with rings, lost parents and rows given twice, followed by a quarter of its spans at a time."""
    from specflow.operators import traces

    monkeypatch.setattr(traces, "FOLLOWED", 20)
    draw = random.Random(3)
    parents = {i: i - 1 if draw.random() < 0.9 else draw.randrange(i) for i in range(1, 600)} | {0: None, 600: 603, 601: 600, 602: 601, 603: 602, 604: 602, 605: 9999}

    def depth(i):
        steps = 0
        while parents.get(i, -1) is not None:
            i, steps = parents.get(i, -1), steps + 1
            if steps > 700 or i not in parents:
                return None
        return steps

    rows = [(t, i, p) for t in ("a", "b") for i, p in parents.items()]
    frame = spark.createDataFrame(rows, "trace_id string, span_id bigint, parent_id int")
    got = {(r.trace_id, r.span_id): r.depth for r in traces.with_depth(frame).collect()}
    assert got == {(t, i): depth(i) for t, i, _ in rows}

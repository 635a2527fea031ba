"""Window, deduplication, threshold and action-chain queries over the events table."""

from __future__ import annotations

from datetime import UTC, timedelta

from pyspark.sql import functions as F

from specflow.catalog.base import register, sql_stamp, stamp
from specflow.operators import actions, windows
from specflow.operators.dedup import checksum, first_seen, judged, payload_checksum, rejected
from specflow.operators.ordered import row_numbers
from specflow.operators.revisions import page
from specflow.operators.window_store import WindowStore
from specflow.session import table, work_path


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stamped(frame, *names):
    return frame.withColumns({n: stamp(F.col(n)) for n in names})


@register("win_tumbling", "STR-01, AGG-23", f"""SELECT {sql_stamp("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, {sql_stamp("time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR")} AS window_end,
 event_type, count(*) AS event_count, {sql_stamp("max(ts)")} AS last_event_at FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type""")
def win_tumbling(spark, sf):
    return _stamped(windows.time_windows(events(spark, sf), "ts", "1 hour", keys=("event_type",)), "window_start", "window_end", "last_event_at")


@register("win_sliding", "STR-02", f"""WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - i * INTERVAL 2 HOUR AS s, ts FROM events, range(3) t(i))
 SELECT {sql_stamp("s")} AS window_start, {sql_stamp("s + INTERVAL 6 HOUR")} AS window_end, count(*) AS event_count, {sql_stamp("max(ts)")} AS last_event_at FROM w GROUP BY s""")
def win_sliding(spark, sf):
    return _stamped(windows.time_windows(events(spark, sf), "ts", "6 hours", "2 hours"), "window_start", "window_end", "last_event_at")


@register("win_session", "STR-03", f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER w) // 1000) >= 7200000 THEN 1 ELSE 0 END AS opens
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM g)
 SELECT user_id, session_no, {sql_stamp("min(ts)")} AS session_start, {sql_stamp("max(ts)")} AS session_last, count(*) AS event_count FROM n GROUP BY user_id, session_no""")
def win_session(spark, sf):
    return _stamped(windows.sessions(events(spark, sf), "user_id", "ts", "event_id", 7_200_000), "session_start", "session_last")


def _range(frame, ts):
    """First and last day of the data: one row, whatever the data's size."""
    row = frame.agg(F.date_trunc("day", F.min(ts)).alias("a"), F.max(ts).alias("b")).first()
    return row["a"].replace(tzinfo=UTC), row["b"].replace(tzinfo=UTC) + timedelta(days=1)


def _business_days(spark, sf, cap=None):
    start, end = _range(events(spark, sf), "ts")
    return windows.instances(spark, "0 0 8 * * MON-FRI ?", "0 0 17 * * MON-FRI ?", start, end, "America/New_York", cap)


# New York is five hours behind UTC over the winter months of the events table.
NY = "(ts - INTERVAL 5 HOUR)"


@register("win_cron", "STR-04, JOI-10", f"""SELECT {sql_stamp(f"date_trunc('day', {NY}) + INTERVAL 13 HOUR")} AS opened_at, {sql_stamp(f"date_trunc('day', {NY}) + INTERVAL 22 HOUR")} AS closed_at,
 count(*) AS event_count, {sql_stamp("max(ts)")} AS last_event_at FROM events WHERE isodow({NY}) <= 5 AND hour({NY}) >= 8 AND hour({NY}) < 17 GROUP BY date_trunc('day', {NY})""")
def win_cron(spark, sf):
    """Weekdays 08:00-17:00 New York time, as intervals joined by day bucket."""
    joined = windows.assign(events(spark, sf), "ts", _business_days(spark, sf))
    return _stamped(windows.summary(joined, "ts", ("opened_at", "closed_at")), "opened_at", "closed_at", "last_event_at")


NIGHT = "date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 22 HOUR"


@register("win_overnight", "STR-04, JOI-10", f"""SELECT {sql_stamp(NIGHT)} AS opened_at, {sql_stamp(f"{NIGHT} + INTERVAL 8 HOUR")} AS closed_at, count(*) AS event_count, {sql_stamp("max(ts)")} AS last_event_at
 FROM events WHERE hour(ts) >= 22 OR hour(ts) < 6 GROUP BY {NIGHT}""")
def win_overnight(spark, sf):
    """Nights from 22:00 to 06:00; the first one opened before the first event's day."""
    ev = events(spark, sf)
    start, end = _range(ev, "ts")
    joined = windows.assign(ev, "ts", windows.instances(spark, "0 0 22 * * ?", "0 0 6 * * ?", start, end))
    return _stamped(windows.summary(joined, "ts", ("opened_at", "closed_at")), "opened_at", "closed_at", "last_event_at")


@register("join_event_window", "JOI-10", """SELECT event_id, CAST(date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS VARCHAR) AS opened_at
 FROM events WHERE (epoch_us(ts) // 1000) < (epoch_us(date_trunc('minute', ts)) // 1000) + 60000 AND minute(ts) % 30 < 29""")
def join_event_window(spark, sf):
    """Half-hour windows that close a minute before the next opens; events in the gap have no window."""
    ev = events(spark, sf)
    start, end = _range(ev, "ts")
    frame = windows.instances(spark, "0 0/30 * * * ?", "0 29/30 * * * ?", start, end)
    joined = windows.assign(ev.select("event_id", "ts"), "ts", frame)
    return joined.select("event_id", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss").alias("opened_at"))


@register("win_count", "STR-05, WIN-05", """SELECT event_type, floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / 100)::BIGINT AS window_no, event_id FROM events""")
def win_count(spark, sf):
    return windows.count_windows(events(spark, sf), ("event_type",), ("ts", "event_id"), 100).select("event_type", "window_no", "event_id")


@register("count_window", "WIN-05", """SELECT user_id, window_no, count(*) AS event_count, min(event_id) AS first_event FROM (
 SELECT user_id, event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 25)::BIGINT AS window_no FROM events) GROUP BY ALL""")
def count_window(spark, sf):
    done = windows.count_windows(events(spark, sf), ("user_id",), ("ts", "event_id"), 25)
    return done.groupBy("user_id", "window_no").agg(F.count(F.lit(1)).alias("event_count"), F.min("event_id").alias("first_event"))


@register("win_event", "STR-06", """SELECT event_id, user_id, (count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) - CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS window_no FROM events""")
def win_event(spark, sf):
    """A purchase closes the user's window."""
    done = windows.marker_windows(events(spark, sf), ("user_id",), ("ts", "event_id"), F.col("event_type") == "purchase")
    return done.select("event_id", "user_id", "window_no")


# Arrival lags event time by the event's value in seconds.
LATE_SQL = """WITH a AS (SELECT event_id, ts, (epoch_us(ts) // 1000) + CAST(floor(value * 1000) AS BIGINT) AS arrival_ms, (epoch_us(time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE) // 1000) AS close_ms FROM events),
 v AS (SELECT *, CASE WHEN arrival_ms < close_ms THEN 'ON_TIME' WHEN arrival_ms <= close_ms + 30000 THEN 'LATE' ELSE 'WINDOW_CLOSED' END AS verdict FROM a)"""


def _arrivals(spark, sf):
    ev = events(spark, sf)
    arrival = F.timestamp_millis(F.unix_millis("ts") + F.floor(F.col("value") * 1000).cast("bigint"))
    close = F.window("ts", "15 minutes")["end"]
    placed = ev.select("event_id", "ts", arrival.alias("arrival"), close.alias("close"))
    return placed.withColumn("verdict", windows.arrival_verdict(F.col("arrival"), F.col("close"), True, 30_000))


@register("late_accept", "STR-07", LATE_SQL + " SELECT event_id, verdict FROM v WHERE verdict <> 'WINDOW_CLOSED'")
def late_accept(spark, sf):
    return _arrivals(spark, sf).filter("verdict <> 'WINDOW_CLOSED'").select("event_id", "verdict")


@register("late_reject", "STR-07, STR-08", LATE_SQL + " SELECT event_id, verdict FROM v WHERE verdict = 'WINDOW_CLOSED'")
def late_reject(spark, sf):
    return _arrivals(spark, sf).filter("verdict = 'WINDOW_CLOSED'").select("event_id", "verdict")


@register("collect_result", "STR-08, SET-03", """WITH a AS (SELECT *, (epoch_us(ts) // 1000) + CAST(floor(value * 1000) AS BIGINT) < (epoch_us(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR) // 1000) AS intime, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events),
 d AS (SELECT *, row_number() OVER (PARTITION BY intime, w, event_type, user_id ORDER BY ts, event_id) AS rn FROM a)
 SELECT event_id, intime AND rn = 1 AS accepted, CASE WHEN NOT intime THEN 'WINDOW_CLOSED' WHEN rn > 1 THEN 'DUPLICATE_CHECKSUM' END AS reason FROM d""")
def collect_result(spark, sf):
    """Late events are refused first; the rest are deduplicated by fields inside their window."""
    ev = events(spark, sf)
    window = F.window("ts", "1 hour")
    arrival = F.timestamp_millis(F.unix_millis("ts") + F.floor(F.col("value") * 1000).cast("bigint"))
    placed = ev.withColumn("w", window).select(
        "event_id", "ts", F.col("w.start").alias("w"), checksum("event_type", "user_id").alias("sum"),
        windows.arrival_verdict(arrival, F.col("w.end"), False, 0).alias("verdict"))
    late = placed.filter(F.col("verdict") == windows.WINDOW_CLOSED).select(
        "event_id", F.lit(False).alias("accepted"), F.col("verdict").alias("reason"))
    done = judged(placed.filter(F.col("verdict") != windows.WINDOW_CLOSED), ["w", "sum"], ["ts", "event_id"], "event_id")
    return done.select("event_id", "accepted", "reason").unionByName(late)


@register("event_checksum", "PRJ-26", """SELECT event_id, sha256(length(event_type) || ':' || event_type || length(CAST(user_id AS VARCHAR)) || ':' || user_id) AS by_fields, sha256(props) AS by_payload FROM events""")
def event_checksum(spark, sf):
    return table(spark, sf, "events").select("event_id", checksum("event_type", "user_id").alias("by_fields"), payload_checksum(F.col("props")).alias("by_payload"))


@register("dedup_payload", "SET-02", "SELECT arg_min(doc_id, doc_id) AS doc_id, sha256(text) AS checksum FROM documents GROUP BY text")
def dedup_payload(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", payload_checksum(F.col("text")).alias("checksum"))
    return first_seen(docs, ["checksum"], ["doc_id"])


DAY_DEDUP = "row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type ORDER BY ts, event_id)"


@register("dedup_fields", "SET-02", f"SELECT event_id FROM (SELECT event_id, {DAY_DEDUP} AS rn FROM events) WHERE rn = 1")
def dedup_fields(spark, sf):
    ev = events(spark, sf).select("event_id", "ts", F.to_date("ts").alias("w"), checksum("user_id", "event_type").alias("sum"))
    return first_seen(ev, ["w", "sum"], ["ts", "event_id"]).select("event_id")


SPLIT_EVENTS = "SELECT o_orderkey * 2 AS id, o_orderstatus || '|' || o_orderpriority AS a, 'x' AS b FROM orders UNION ALL SELECT o_orderkey * 2 + 1, o_orderstatus, o_orderpriority || '|x' FROM orders"


@register("dedup_separators", "SET-02, PRJ-26", f"SELECT a, b, min(id) AS id FROM ({SPLIT_EVENTS}) GROUP BY a, b")
def dedup_separators(spark, sf):
    """Values that hold a separator: what is split differently is a different event."""
    table(spark, sf, "orders").createOrReplaceTempView("dedup_separators_orders")
    rows = spark.sql(SPLIT_EVENTS.replace("FROM orders", "FROM dedup_separators_orders")).withColumn("sum", checksum("a", "b"))
    return first_seen(rows, ["sum"], ["id"]).select("a", "b", "id")


@register("dedup_rejects", "SET-03, STR-15", f"SELECT event_id, 'DUPLICATE_CHECKSUM' AS reason FROM (SELECT event_id, {DAY_DEDUP} AS rn FROM events) WHERE rn > 1")
def dedup_rejects(spark, sf):
    ev = events(spark, sf).select("event_id", "ts", F.to_date("ts").alias("w"), checksum("user_id", "event_type").alias("sum"))
    return rejected(ev, ["w", "sum"], ["ts", "event_id"], "event_id").select("event_id", "reason")


@register("win_state", "STR-10", f"""WITH i AS (SELECT date_trunc('day', ts) + INTERVAL 13 HOUR AS o, date_trunc('day', ts) + INTERVAL 22 HOUR AS c, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY date_trunc('day', ts)),
 m AS (SELECT max(ts) - INTERVAL 36 HOUR AS now FROM events)
 SELECT {sql_stamp("o")} AS opened_at, CASE WHEN e * 4 > n THEN 'ERROR' WHEN now < o THEN 'PENDING' WHEN now < c THEN 'OPEN' WHEN e * 5 > n THEN 'CLOSING' ELSE 'CLOSED' END AS state FROM i, m""")
def win_state(spark, sf):
    """State of one daily window per day, 36 hours before the last event."""
    ev = events(spark, sf)
    day = F.date_trunc("day", "ts")
    frame = ev.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    now = ev.agg(F.max("ts") - F.expr("INTERVAL 36 HOURS")).scalar()
    frame = frame.select((F.col("d") + F.expr("INTERVAL 13 HOURS")).alias("opened_at"), (F.col("d") + F.expr("INTERVAL 22 HOURS")).alias("closed_at"), "n", "e")
    done = windows.with_state(frame, now, F.col("e") * 5 <= F.col("n"), F.col("e") * 4 > F.col("n"))
    return _stamped(done.select("opened_at", "state"), "opened_at")


@register("win_transitions", "STR-10", """WITH h AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'OPENING' WHEN 'view' THEN 'OPEN' WHEN 'click' THEN 'CLOSING' WHEN 'purchase' THEN 'CLOSED' ELSE 'ERROR' END AS s FROM events),
 l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM h)
 SELECT p AS old_state, s AS new_state, count(*) AS n, bool_and((p = 'OPENING' AND s IN ('OPEN','ERROR')) OR (p = 'OPEN' AND s IN ('CLOSING','ERROR')) OR (p = 'CLOSING' AND s IN ('CLOSED','ERROR')) OR (p = 'ERROR' AND s IN ('OPENING','CLOSING'))) AS allowed
 FROM l WHERE p IS NOT NULL GROUP BY ALL""")
def win_transitions(spark, sf):
    from specflow.operators.ordered import previous

    names = {"signup": "OPENING", "view": "OPEN", "click": "CLOSING", "purchase": "CLOSED"}
    state = F.lit("ERROR")
    for kind, name in names.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    h = events(spark, sf).select("user_id", "ts", "event_id", state.alias("new_state"))
    back = previous(h, ("user_id",), ("ts", "event_id"), {"old_state": F.col("new_state")}).filter("old_state is not null")
    done = back.groupBy("old_state", "new_state").agg(F.count(F.lit(1)).alias("n"))
    return done.withColumn("allowed", windows.transition_allowed(F.col("old_state"), F.col("new_state")))


@register("win_ticks", "STR-11", f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
 SELECT {sql_stamp("CAST(d AS TIMESTAMP) + INTERVAL 8 HOUR")} AS opened_at, {sql_stamp("CAST(d AS TIMESTAMP) + INTERVAL 8 HOUR + i * INTERVAL 45 MINUTE")} AS tick_at FROM d, range(1, 12) t(i) WHERE i * 45 < 540""")
def win_ticks(spark, sf):
    days = events(spark, sf).select(F.date_trunc("day", "ts").alias("d")).distinct()
    frame = days.select((F.col("d") + F.expr("INTERVAL 8 HOURS")).alias("opened_at"), (F.col("d") + F.expr("INTERVAL 17 HOURS")).alias("closed_at"))
    return _stamped(windows.ticks(frame, "45 minutes").select("opened_at", "tick_at"), "opened_at", "tick_at")


@register("win_cap", "STR-12", f"""SELECT {sql_stamp(f"date_trunc('day', {NY}) + INTERVAL 13 HOUR")} AS opened_at, {sql_stamp(f"date_trunc('day', {NY}) + INTERVAL 17 HOUR")} AS closed_at, count(*) AS event_count
 FROM events WHERE isodow({NY}) <= 5 AND hour({NY}) >= 8 AND hour({NY}) < 12 GROUP BY date_trunc('day', {NY})""")
def win_cap(spark, sf):
    joined = windows.assign(events(spark, sf), "ts", windows.capped(_business_days(spark, sf), 240))
    counted = joined.groupBy("opened_at", "closed_at").agg(F.count(F.lit(1)).alias("event_count"))
    return _stamped(counted, "opened_at", "closed_at")


@register("empty_windows", "SET-07, STR-13", f"""WITH c AS (SELECT unnest(range(date_trunc('day', (SELECT min(ts) FROM events)), date_trunc('day', (SELECT max(ts) FROM events)) + INTERVAL 1 DAY, INTERVAL 5 MINUTE)) AS w),
 n AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) AS n FROM events GROUP BY 1)
 SELECT {sql_stamp("c.w")} AS window_start, coalesce(n, 0) AS event_count, n IS NULL AS on_empty_close FROM c LEFT JOIN n ON n.w = c.w""")
def empty_windows(spark, sf):
    """Every five-minute window of the covered days, quiet ones too."""
    ev = events(spark, sf)
    ends = ev.agg(F.date_trunc("day", F.min("ts")).alias("a"), F.date_trunc("day", F.max("ts")).alias("b"))
    # one row per day first, so the calendar is spread over tasks
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("d")).repartition("d")
    last = F.col("d") + F.expr("INTERVAL 1435 MINUTES")
    calendar = days.select(F.explode(F.sequence("d", last, F.expr("INTERVAL 5 MINUTES"))).alias("window_start"))
    counted = ev.groupBy(F.window("ts", "5 minutes")["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("event_count"))
    done = windows.with_empty(counted, calendar, ["window_start"])
    return _stamped(done.withColumn("on_empty_close", F.col("event_count") == 0), "window_start")


@register("window_summary", "AGG-23", f"SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS event_count, {sql_stamp('max(ts)')} AS last_event_at FROM events GROUP BY user_id, CAST(ts AS DATE)")
def window_summary(spark, sf):
    ev = events(spark, sf).withColumn("day", F.to_date("ts").cast("string"))
    return _stamped(windows.summary(ev, "ts", ("user_id", "day")), "last_event_at")


@register("threshold_fire", "WIN-04, STR-14", """SELECT event_id, running_count, running_count // 50 AS trigger_no FROM (
 SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS running_count FROM events) WHERE running_count % 50 = 0 AND running_count // 50 <= 4""")
def threshold_fire(spark, sf):
    ev = events(spark, sf).withColumn("day", F.to_date("ts"))
    return windows.threshold_fires(ev, ("day",), ("ts", "event_id"), 50, limit=4).select("event_id", "running_count", "trigger_no")


@register("batch_split", "WIN-03", "SELECT o_orderkey AS id, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000)::BIGINT AS file_no FROM orders")
def batch_split(spark, sf):
    """One global numbering, cut into files; no task ever sees more than its key range."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return windows.count_windows(orders, (), ("id",), 1000, "file_no").select("id", "file_no")


@register("win_reprocess", "STR-16", """WITH d AS (SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS half, CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events) AS newest FROM events GROUP BY ALL)
 SELECT 1::BIGINT AS version, day, event_type, CASE WHEN newest THEN n ELSE half END AS event_count FROM d WHERE newest OR half > 0
 UNION ALL SELECT 0, day, event_type, half FROM d WHERE half > 0""")
def win_reprocess(spark, sf):
    """Daily windows over half of the users; then the newest day runs again over all of them and replaces
    that window only. Readers of the first version still have it."""
    ev = events(spark, sf).withColumn("day", F.to_date("ts").cast("string"))
    counted = lambda some: some.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("event_count"))
    store = WindowStore(spark, work_path(spark, "windows"), "day")
    first = store.publish(counted(ev.filter("user_id % 2 = 0")))
    newest = ev.agg(F.max("day")).first()[0]
    second = store.replace(newest, counted(ev.filter(F.col("day") == newest)))
    read = [store.read(v).select(F.lit(v).cast("bigint").alias("version"), "day", "event_type", "event_count") for v in (first, second)]
    return read[0].unionByName(read[1])


@register("win_each_second", "STR-04, JOI-10, STR-12", f"""SELECT {sql_stamp("date_trunc('second', ts)")} AS opened_at, {sql_stamp("date_trunc('minute', ts) + INTERVAL 1 MINUTE")} AS closed_at, count(*) AS event_count
 FROM events GROUP BY date_trunc('second', ts), date_trunc('minute', ts)""")
def win_each_second(spark, sf):
    """A window opens every second, over all days of the table, and lasts to the end of its minute; events counted by the last one opened."""
    ev = events(spark, sf).select("event_id", "ts")
    start, end = _range(ev, "ts")
    frame = windows.instances(spark, "* * * * * ?", "0 * * * * ?", start, end)
    # the newest of the windows open at an event's time
    joined = windows.assign(ev, "ts", frame).groupBy("event_id").agg(F.max("opened_at").alias("opened_at"), F.min("closed_at").alias("closed_at"))
    counted = joined.groupBy("opened_at", "closed_at").agg(F.count(F.lit(1)).alias("event_count"))
    return _stamped(counted, "opened_at", "closed_at")


@register("win_events", "STR-17", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02' ORDER BY ts, event_id LIMIT 20 OFFSET 40")
def win_events(spark, sf):
    inside = events(spark, sf).filter(F.to_date("ts") == F.lit("2024-01-02").cast("date"))
    return page(inside.select("event_id", "event_type", "ts"), ["ts", "event_id"], 2, 20).select("event_id", "event_type")


CHAIN_SQL = """WITH a AS (SELECT l_orderkey AS run, l_returnflag AS cond, l_linenumber AS no, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_quantity >= 10 AS ok, l_discount > 0.04 AS cont,
 CAST(round(l_tax * 100) AS BIGINT) AS duration_ms FROM lineitem),
 n AS (SELECT *, coalesce(sum(CASE WHEN NOT ok AND NOT cont THEN 1 ELSE 0 END) OVER (PARTITION BY run, cond ORDER BY no, p, s, q, duration_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM a),
 r AS (SELECT *, CASE WHEN b > 0 THEN 'SKIPPED' WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END AS status, b = 0 AND NOT ok AND NOT cont AS fires FROM n)"""


def chain(spark, sf):
    """Line items as action attempts of a run (order) and condition (return flag)."""
    a = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("cond"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_quantity") >= 10).alias("succeeded"),
        (F.col("l_discount") > 0.04).alias("continue_on_failure"), F.round(F.col("l_tax") * 100).cast("bigint").alias("duration_ms"))
    return actions.chain_outcome(a, ("run", "cond"), ("no", "p", "s", "q", "duration_ms"))


@register("action_chain", "STR-18", CHAIN_SQL + " SELECT run, cond, no, p, status, fires AS fires_on_error FROM r")
def action_chain(spark, sf):
    return chain(spark, sf).select("run", "cond", "no", "p", "status", "fires_on_error")


@register("action_outcomes", "AGG-26", CHAIN_SQL + " SELECT cond, status, count(*) AS n, sum(duration_ms)::BIGINT AS total_duration_ms FROM r GROUP BY ALL")
def action_outcomes(spark, sf):
    return actions.outcome_counts(chain(spark, sf), ["cond"])


@register("numbered_split", "WIN-03, PRJ-01", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events")
def numbered_split(spark, sf):
    """Row numbers by the chunked way that hot groups take."""
    return row_numbers(events(spark, sf), ("event_type",), ("ts", "event_id"), split=True).select("event_id", "rn")

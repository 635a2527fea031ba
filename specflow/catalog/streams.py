"""Streaming queries, run over everything available and read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from specflow.catalog.base import ORDER, ORDER_FIELDS, ORDER_SPEC, ORDER_SQL, columns, register, sql_stamp, stamp
from specflow.catalog.flows import FILE_OF
from specflow.catalog.sources import FILE_OF as SOURCE_FILE_OF
from specflow.catalog.sources import TRANSFER, escaped, unescaped, write_files, write_transfers
from specflow.session import table, work_path
from specflow.spec import load_spec
from specflow.streaming import book, intake, keyed, late, runs, sources, windows


#: rows of a file that a stream polls
FILE_ROWS = 4_000_000


def polled_in_turn(spark, rows, part, parts, label):
    """A stream that polls ``rows`` part by part, in that order, each in files of bounded size.

    File streams take files by their time of writing, so the parts are written one after the other.
    """
    path, total = work_path(spark, label), rows.count()
    files = max(1, -(-total // (parts * FILE_ROWS)))
    for number in range(parts):
        rows.filter(part == number).repartition(files).write.mode("append").parquet(path)
    return sources.table_stream(spark, path, rows.schema, files_per_poll=files)


def split_stream(spark, sf, parts=4):
    """The events table in the order of its events, a quarter per batch."""
    events = table(spark, sf, "events")
    ends = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    part = F.call_function("div", (F.col("event_id") - ends["low"]) * parts, F.lit(ends["high"] - ends["low"] + 1))
    return polled_in_turn(spark, events, part, parts, "events")


@register("stream_tumbling", "STR-01", f"""SELECT {sql_stamp("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, event_type, count(*) AS event_count FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type""")
def stream_tumbling(spark, sf):
    """Complete mode: the last batch holds all windows."""
    counted = windows.windowed_counts(windows.event_time(split_stream(spark, sf), "ts", "1 hour"), "ts", "1 hour", keys=("event_type",))
    done = runs.run_to_folder(counted, "stream-tumbling", "complete", whole=True)
    return done.select(stamp(F.col("window_start")).alias("window_start"), "event_type", "event_count")


@register("stream_sliding", "STR-02", f"""WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - i * INTERVAL 2 HOUR AS s FROM events, range(3) t(i)) SELECT {sql_stamp("s")} AS window_start, count(*) AS event_count FROM w GROUP BY s""")
def stream_sliding(spark, sf):
    counted = windows.windowed_counts(windows.event_time(split_stream(spark, sf), "ts", "1 hour"), "ts", "6 hours", "2 hours")
    done = runs.run_to_folder(counted, "stream-sliding", "complete", whole=True)
    return done.select(stamp(F.col("window_start")).alias("window_start"), "event_count")


@register("stream_session", "STR-03", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS opens
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS event_count FROM n GROUP BY user_id, no""")
def stream_session(spark, sf):
    counted = windows.session_counts(windows.event_time(split_stream(spark, sf), "ts", "1 hour"), "ts", "user_id", "2 hours")
    done = runs.run_to_folder(counted, "stream-session", "complete", whole=True)
    return done.select("user_id", stamp(F.col("session_start")).alias("session_start"), "event_count")


# Users whose number ends in 3 send through a relay that is a part of the range behind.
LATE_PARTS = 5
SPAN = "greatest((SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events), 1)"
LATE_SQL = f"""WITH p AS (SELECT *, (((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) * {LATE_PARTS - 1}) // {SPAN}) + CASE WHEN user_id % 10 = 3 THEN 1 ELSE 0 END AS part FROM events),
 q AS (SELECT *, least(part, {LATE_PARTS - 1}) AS batch FROM p),
 m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM q GROUP BY batch),
 v AS (SELECT event_id, mark, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS close FROM q JOIN m USING (batch))
SELECT event_id, CASE WHEN mark IS NULL OR mark < close THEN 'ON_TIME' WHEN epoch_us(mark) // 1000 <= epoch_us(close) // 1000 + 172800000 THEN 'LATE' ELSE 'WINDOW_CLOSED' END AS verdict FROM v"""


@register("stream_late", "STR-07, STR-08", LATE_SQL)
def stream_late(spark, sf):
    """Daily windows that take late events for two days more; a tenth of the users is days behind.

    Accepted and rejected events are all events, with the verdicts that the whole table gives.
    """
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    ends = events.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    part = F.call_function("div", (at - ends["low"]) * (LATE_PARTS - 1), F.lit(max(ends["high"] - ends["low"], 1)))
    batch = F.least(part + (F.col("user_id") % 10 == 3).cast("int"), F.lit(LATE_PARTS - 1))
    stream = polled_in_turn(spark, events, batch, LATE_PARTS, "late-events")
    folder = work_path(spark, "late")
    close = F.window("ts", "1 day")["end"]
    runs.run_each(stream, late.late_writer("ts", close, folder, True, 172_800_000), work_path(spark, "late-checkpoint"))
    taken = late.side(folder, stream, "accepted").select("event_id", "verdict")
    return taken.unionByName(late.side(folder, stream, "rejected").select("event_id", F.col("reason").alias("verdict")))


@register("stream_dedup", "STR-09", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE)::VARCHAR AS day FROM events")
def stream_dedup(spark, sf):
    stream = windows.event_time(split_stream(spark, sf), "ts", "25 hours").withColumn("day", F.to_date("ts").cast("string"))
    done = runs.run_to_folder(windows.deduplicated(stream, ["user_id", "event_type", "day"]), "stream-dedup", whole=True)
    return done.select("user_id", "event_type", "day")


@register("stream_count_windows", "STR-05", """SELECT user_id, window_no, count(*) AS event_count FROM (SELECT user_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 10)::BIGINT AS window_no FROM events) GROUP BY ALL""")
def stream_count_windows(spark, sf):
    """Windows of ten arrivals per user, carried over four batches."""
    out, state = work_path(spark, "count-windows"), work_path(spark, "count-state")
    each = keyed.count_windows(("user_id",), ("ts", "event_id"), 10, state, out)
    runs.run_each(split_stream(spark, sf), each, work_path(spark, "count-checkpoint"))
    done = spark.read.option("basePath", out).parquet(f"{out}/batch_no=*")
    return done.groupBy("user_id", "window_no").agg(F.count(F.lit(1)).alias("event_count"))


@register("stream_marker_windows", "STR-06", """SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS closed_windows FROM events GROUP BY 1""")
def stream_marker_windows(spark, sf):
    """Each purchase closes a window: a user has as many closed windows as purchases."""
    out, state = work_path(spark, "marker-windows"), work_path(spark, "marker-state")
    each = keyed.marker_windows(("user_id",), ("ts", "event_id"), F.col("event_type") == "purchase", state, out)
    runs.run_each(split_stream(spark, sf), each, work_path(spark, "marker-checkpoint"))
    done = spark.read.option("basePath", out).parquet(f"{out}/batch_no=*")
    closes = F.when(F.col("event_type") == "purchase", F.col("window_no"))
    return done.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(closes).alias("closed_windows"))


def _order_files(spark, sf, label):
    rows = columns(spark, sf, "orders", {"b": FILE_OF, **ORDER}).select("b", "k", F.concat_ws("|", *ORDER_FIELDS).alias("value"))
    return write_files(rows, work_path(spark, label), ["b"])


@register("stream_file_poll", "SRC-28", f"SELECT {FILE_OF} AS b, count(*) AS n FROM orders GROUP BY 1")
def stream_file_poll(spark, sf):
    """A folder polled twenty files at a time until nothing new is left."""
    lines = sources.poll_lines(spark, _order_files(spark, sf, "poll"))
    done = runs.run_to_folder(lines, "stream-poll")
    return done.groupBy(F.regexp_extract("_file", "/b=([0-9]+)/", 1).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _streamed_events(spark, files, spec, out):
    runs.run_each(files, intake.event_writer(spec, out, "run-1"), work_path(spark, "events-checkpoint"))
    return spark.read.option("basePath", f"{out}/events").parquet(f"{out}/events/batch_no=*")


@register("stream_iso20022", "STR-19, SRC-16", f"""SELECT 'E' || CAST(o_orderkey AS VARCHAR) AS chain, 'M-' || CAST({SOURCE_FILE_OF} AS VARCHAR) AS message,
 'payer ' || substr(o_orderpriority, 1, 1) || ' of ' || CAST({SOURCE_FILE_OF} AS VARCHAR) AS payer FROM orders""")
def stream_iso20022(spark, sf):
    """Payment messages as they arrive, each transfer with the headers of its message and block."""
    files = sources.poll_files(spark, write_transfers(spark, sf), files_per_poll=500)
    made = _streamed_events(spark, files, TRANSFER, work_path(spark, "iso-events"))
    return made.select(*[F.get_json_object("value", f"$.fields.{n}").alias(n) for n in ("chain", "message", "payer")])


LATIN = load_spec({"id": "latin", "format": "DELIMITED", "delimiter": "|", "encoding": "ISO-8859-1", "recordSeparator": "~", "fields": [
    {"name": "id", "type": "LONG", "columnIndex": 0}, {"name": "text", "columnIndex": 1, "required": False, "nullable": True}]})


@register("stream_latin_events", "STR-19, SRC-08, SRC-09", "SELECT doc_id AS id, text FROM documents WHERE trim(text) <> ''")
def stream_latin_events(spark, sf):
    """Documents in another charset and with a separator of their own, so that they keep their line breaks."""
    path, marks = work_path(spark, "latin"), ("~", "|", '"')
    rows = columns(spark, sf, "documents", {"line": f"CAST(doc_id AS STRING) || '|.' || {escaped('text', *marks)} || '.'", "filled": "trim(text) <> ''"}).filter("filled")
    rows.select(F.encode("line", "ISO-8859-1").cast("string").alias("value")).write.option("lineSep", "~").text(path)
    made = _streamed_events(spark, sources.poll_files(spark, path, files_per_poll=500), LATIN, work_path(spark, "latin-events"))
    v = F.parse_json("value")
    text = unescaped(F.variant_get(v, "$.fields.text", "string"), *marks)
    return made.select(F.variant_get(v, "$.fields.id", "bigint").alias("id"), F.substr(text, F.lit(2), F.length(text) - 2).alias("text"))


@register("stream_file_to_events", "STR-19", ORDER_SQL + "SELECT k, corrected FROM run WHERE NOT fatal")
def stream_file_to_events(spark, sf):
    out = work_path(spark, "stream-events")
    files = sources.poll_files(spark, _order_files(spark, sf, "inbox"), files_per_poll=2000)
    v, made = F.parse_json("value"), _streamed_events(spark, files, ORDER_SPEC, out)
    return made.select(
        F.substring(F.variant_get(v, "$.fields.orderNo", "string"), 2, 20).cast("bigint").alias("k"),
        F.variant_get(v, "$.corrected", "boolean").alias("corrected"))


@register("stream_ledger", "STR-20", f"SELECT {FILE_OF} AS b, count(*) AS n_lines, 1::BIGINT AS n_rows FROM orders GROUP BY 1")
def stream_ledger(spark, sf):
    """The same folder taken in by two streams at the same time into one ledger: one row per file."""
    folder, home = _order_files(spark, sf, "ledger-inbox"), work_path(spark, "book")
    running = [
        runs.start_each(sources.poll_lines(spark, folder, files_per_poll=per_poll), book.ledger_writer(home, 1, stream), work_path(spark, f"book-{stream}"))
        for stream, per_poll in (("first", 5), ("second", 8))
    ]
    for query in running:
        query.awaitTermination()
    rows = book.read_book(spark, home)
    b = F.regexp_extract("remote_file_name", "/b=([0-9]+)/", 1).cast("bigint")
    return rows.groupBy(b.alias("b")).agg(F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("n_rows"))

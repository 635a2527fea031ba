"""Log and trace queries. Events and documents stand for log lines; orders and their items for spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from specflow.catalog.base import columns, register, sql_stamp, stamp
from specflow.catalog.windows import events
from specflow.operators import logs, traces
from specflow.operators.ordered import previous
from specflow.session import table

LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
LOGS = f"""WITH logs AS (SELECT event_id, ts, {LEVEL} AS level, 'app.' || event_type || '.Worker' AS logger, props AS message,
 CASE WHEN event_type = 'click' THEN NULL ELSE 'T' || CAST(user_id AS VARCHAR) END AS trace_id, value FROM events) """


def log_lines(spark, sf):
    return events(spark, sf).selectExpr(
        "event_id", "ts", f"{LEVEL} AS level", "'app.' || event_type || '.Worker' AS logger", "props AS message",
        "CASE WHEN event_type = 'click' THEN NULL ELSE 'T' || CAST(user_id AS STRING) END AS trace_id", "value")


def _filter(name, condition, sql):
    @register(name, "RTE-08", LOGS + f"SELECT event_id FROM logs WHERE {sql}")
    def run(spark, sf):
        return log_lines(spark, sf).filter(condition()).select("event_id")


_filter("log_filter_exact", lambda: F.col("level") == "ERROR", "level = 'ERROR'")
_filter("log_filter_wildcard", lambda: logs.wildcard(F.col("logger"), "app.*ck*"), "logger LIKE 'app.%ck%'")
_filter("log_filter_range", lambda: F.col("value").between(10, 40) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")), "value BETWEEN 10 AND 40 AND ts >= TIMESTAMP '2024-01-10'")
_filter("log_filter_boolean", lambda: F.col("level").isin("ERROR", "WARN") & ~(F.col("trace_id") == "T42"), "(level = 'ERROR' OR level = 'WARN') AND NOT trace_id = 'T42'")
_filter("log_filter_not", lambda: ~F.col("level").isin("DEBUG", "INFO"), "NOT level = 'DEBUG' AND NOT level = 'INFO'")
_filter("log_filter_exists", lambda: F.col("trace_id").isNotNull(), "trace_id IS NOT NULL")


@register("log_filter_phrase", "RTE-08", "SELECT doc_id FROM documents WHERE contains(text, 'the ') OR contains(text, 'der ')")
def log_filter_phrase(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(logs.phrase(F.col("text"), "the ") | logs.phrase(F.col("text"), "der ")).select("doc_id")


@register("log_recent_errors", "RTE-09", LOGS + f"SELECT event_id, {sql_stamp('ts')} AS at FROM logs WHERE level = 'ERROR' AND ts >= (SELECT max(ts) FROM logs) - INTERVAL 6 HOUR ORDER BY ts DESC, event_id LIMIT 20")
def log_recent_errors(spark, sf):
    done = logs.recent(log_lines(spark, sf), "ts", "ERROR", 6 * 3600, 20, ["event_id"])
    return done.select("event_id", stamp(F.col("ts")).alias("at"))


@register("log_latest", "SRT-05", LOGS + "SELECT event_id, level FROM logs ORDER BY ts DESC, event_id LIMIT 30")
def log_latest(spark, sf):
    return log_lines(spark, sf).orderBy(F.desc("ts"), "event_id").limit(30).select("event_id", "level")


@register("log_by_trace", "SRT-06", LOGS + f"SELECT event_id, level, {sql_stamp('ts')} AS at FROM logs WHERE trace_id = 'T7' ORDER BY ts, event_id")
def log_by_trace(spark, sf):
    done = log_lines(spark, sf).filter("trace_id = 'T7'").orderBy("ts", "event_id")
    return done.select("event_id", "level", stamp(F.col("ts")).alias("at"))


@register("log_histogram", "AGG-20", LOGS + f"SELECT {sql_stamp('time_bucket(INTERVAL 1 HOUR, ts)')} AS window_start, level, count(*) AS n FROM logs GROUP BY time_bucket(INTERVAL 1 HOUR, ts), level")
def log_histogram(spark, sf):
    return logs.level_histogram(log_lines(spark, sf), "ts", "1 hour").withColumn("window_start", stamp(F.col("window_start")))


@register("log_top_messages", "AGG-21", LOGS + "SELECT message, count(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY 1 ORDER BY n DESC, message LIMIT 10")
def log_top_messages(spark, sf):
    return logs.top_messages(log_lines(spark, sf).filter("level = 'ERROR'"), 10)


# Alerts: errors of an unusually high value.
NEAR = LOGS + ", alerts AS (SELECT event_id, ts FROM logs WHERE level = 'ERROR' AND value > 120) "


def _alerts(spark, sf):
    return log_lines(spark, sf).filter("level = 'ERROR' and value > 120").select("event_id", "ts")


MS = "(epoch_us({}) // 1000)"


@register("join_range_alert", "JOI-07", NEAR + f"SELECT event_id FROM logs l WHERE EXISTS (SELECT 1 FROM alerts a WHERE abs({MS.format('l.ts')} - {MS.format('a.ts')}) <= 300000)")
def join_range_alert(spark, sf):
    """Lines within five minutes of any alert; neighbourhoods are merged first, so no line is paired twice."""
    spans = logs.alert_spans(_alerts(spark, sf), "ts", "event_id", 300)
    return logs.near_alerts(log_lines(spark, sf), "ts", spans, 3_600_000).select("event_id")


@register("alert_line_counts", "JOI-07", NEAR + f"SELECT a.event_id, count(*) AS n_lines FROM alerts a JOIN logs l ON abs({MS.format('l.ts')} - {MS.format('a.ts')}) <= 300000 GROUP BY 1")
def alert_line_counts(spark, sf):
    return logs.counts_near_alerts(log_lines(spark, sf), _alerts(spark, sf), "ts", "event_id", 300)


# --- traces ---------------------------------------------------------------------------

# A trace per customer: the customer's root span, an order span per order, and one span per
# (order, line number) below it. Durations are whole milliseconds.
SPANS = """WITH items AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT))::BIGINT AS ms, max(l_discount) >= 0.09 AS bad FROM lineitem GROUP BY ALL),
 spans AS (
 SELECT 'C' || c_custkey AS trace_id, 'C' || c_custkey AS span_id, CAST(NULL AS VARCHAR) AS parent_id, 'request' AS operation, CAST(floor(abs(c_acctbal)) AS BIGINT) AS duration_ms, c_acctbal < 0 AS is_error FROM customer
 UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'C' || o_custkey, 'order ' || o_orderstatus, CAST(floor(o_totalprice / 1000) AS BIGINT), o_orderpriority = '1-URGENT' FROM orders
 UNION ALL SELECT 'C' || o_custkey, 'L' || l_orderkey || '-' || l_linenumber, 'O' || l_orderkey, 'item', ms, bad FROM items JOIN orders ON l_orderkey = o_orderkey) """


def spans(spark, sf):
    root = columns(spark, sf, "customer", {
        "trace_id": "'C' || c_custkey", "span_id": "'C' || c_custkey", "parent_id": "CAST(NULL AS STRING)", "operation": "'request'",
        "duration_ms": "CAST(floor(abs(c_acctbal)) AS BIGINT)", "is_error": "c_acctbal < 0", "tags": "map('segment', c_mktsegment)"})
    order = columns(spark, sf, "orders", {
        "trace_id": "'C' || o_custkey", "span_id": "'O' || o_orderkey", "parent_id": "'C' || o_custkey", "operation": "'order ' || o_orderstatus",
        "duration_ms": "CAST(floor(o_totalprice / 1000) AS BIGINT)", "is_error": "o_orderpriority = '1-URGENT'", "tags": "map('priority', o_orderpriority)"})
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("duration_ms"), (F.max("l_discount") >= 0.09).alias("is_error"))
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    leaf = items.join(owners, "l_orderkey").selectExpr(
        "'C' || o_custkey AS trace_id", "'L' || l_orderkey || '-' || l_linenumber AS span_id", "'O' || l_orderkey AS parent_id", "'item' AS operation",
        "duration_ms", "is_error", "CAST(map() AS map<string,string>) AS tags")
    return root.unionByName(order).unionByName(leaf)


@register("trace_search", "RTE-11", SPANS + """SELECT span_id, duration_ms FROM spans WHERE operation = 'order F' AND duration_ms >= 400 AND span_id IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def trace_search(spark, sf):
    return traces.search(spans(spark, sf), "order F", 400, {"priority": "1-URGENT"}).select("span_id", "duration_ms")


@register("trace_summary", "AGG-22", SPANS + """SELECT trace_id, count(*) AS span_count, count(*) FILTER (WHERE is_error) AS error_count, sum(CASE WHEN parent_id IS NULL THEN duration_ms ELSE 0 END)::BIGINT AS total_ms,
 arg_max(span_id, (duration_ms, span_id)) AS slowest_span FROM spans GROUP BY 1""")
def trace_summary(spark, sf):
    return traces.summary(spans(spark, sf))


@register("trace_slowest", "SRT-05", SPANS + "SELECT trace_id, sum(CASE WHEN parent_id IS NULL THEN duration_ms ELSE 0 END)::BIGINT AS total_ms FROM spans GROUP BY 1 ORDER BY total_ms DESC, trace_id LIMIT 10")
def trace_slowest(spark, sf):
    return traces.summary(spans(spark, sf)).select("trace_id", "total_ms").orderBy(F.desc("total_ms"), "trace_id").limit(10)


@register("trace_compare", "AGG-24", SPANS + """, t AS (SELECT trace_id, sum(CASE WHEN parent_id IS NULL THEN duration_ms ELSE 0 END) AS ms FROM spans GROUP BY 1),
 e AS (SELECT arg_max(trace_id, (ms, trace_id)) AS slow, arg_min(trace_id, (ms, trace_id)) AS fast FROM t)
 SELECT operation, sum(CASE WHEN trace_id = slow THEN duration_ms ELSE 0 END)::BIGINT AS slow_ms, sum(CASE WHEN trace_id = fast THEN duration_ms ELSE 0 END)::BIGINT AS fast_ms,
 sum(CASE WHEN trace_id = slow THEN duration_ms ELSE 0 END)::BIGINT - sum(CASE WHEN trace_id = fast THEN duration_ms ELSE 0 END)::BIGINT AS diff_ms FROM spans, e WHERE trace_id IN (slow, fast) GROUP BY 1""")
def trace_compare(spark, sf):
    return traces.compare_extremes(spans(spark, sf))


@register("join_log_trace", "JOI-06", LOGS + """SELECT event_id, c_custkey, c_acctbal < 0 AS is_error FROM logs JOIN customer ON trace_id = 'T' || CAST(c_custkey AS VARCHAR)""")
def join_log_trace(spark, sf):
    roots = columns(spark, sf, "customer", {"trace_id": "'T' || c_custkey", "c_custkey": "c_custkey", "is_error": "c_acctbal < 0"})
    return log_lines(spark, sf).filter("trace_id is not null").join(roots, "trace_id").select("event_id", "c_custkey", "is_error")


@register("join_span_parent", "JOI-08", SPANS + """SELECT s.span_id, p.operation AS parent_operation FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id""")
def join_span_parent(spark, sf):
    return traces.with_parent(spans(spark, sf)).select("span_id", "parent_operation")


@register("span_depth", "JOI-08", SPANS + "SELECT span_id, CASE substr(span_id, 1, 1) WHEN 'C' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS depth FROM spans")
def span_depth(spark, sf):
    return traces.with_depth(spans(spark, sf)).select("span_id", "depth")


@register("span_depth_chain", "JOI-08", "SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::INT AS depth FROM events")
def span_depth_chain(spark, sf):
    """Every event hangs on the one before of its type: chains of hundreds of spans and more."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("trace_id"), F.col("event_id").alias("span_id"))
    chained = previous(rows, ("trace_id",), ("span_id",), {"parent_id": F.col("span_id")})
    return traces.with_depth(chained).select(F.col("span_id").alias("event_id"), "depth")

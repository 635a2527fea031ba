"""Metric queries. Events stand for counter samples: a counter per type and user that restarts daily."""

from __future__ import annotations

from pyspark.sql import functions as F

from specflow.catalog.base import register, sql_stamp, stamp
from specflow.catalog.windows import events
from specflow.operators import metrics
from specflow.operators.ordered import row_numbers

# The counter counts a type's events of the day; midnight restarts it.
SAMPLES = """WITH s AS (SELECT event_id, ts, event_type AS kind, user_id, value,
 row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) * 3 AS counter FROM events)"""


def samples(spark, sf):
    ev = events(spark, sf).select("event_id", "ts", F.col("event_type").alias("kind"), "user_id", "value", F.to_date("ts").alias("day"))
    numbered = row_numbers(ev, ("kind", "day"), ("ts", "event_id"), "rn")
    return numbered.withColumn("counter", F.col("rn") * 3).drop("rn", "day")


INCREASE = SAMPLES + f""", w AS (SELECT *, (epoch_us(ts) // 1000) // 21600000 * 21600000 AS w FROM s),
 l AS (SELECT *, lag(counter) OVER (PARTITION BY kind, w ORDER BY ts, event_id) AS p FROM w),
 g AS (SELECT kind, w, sum(CASE WHEN p IS NULL THEN 0 WHEN counter < p THEN counter ELSE counter - p END)::BIGINT AS increase, count(*) AS samples FROM l GROUP BY ALL)"""
W = sql_stamp("make_timestamp(w * 1000)")


def _grown(spark, sf):
    return metrics.increase(samples(spark, sf), ("kind",), "ts", "event_id", "counter", 21_600)


@register("metric_increase", "AGG-14, WIN-06", INCREASE + f" SELECT kind, {W} AS window_start, increase, samples FROM g")
def metric_increase(spark, sf):
    return _grown(spark, sf).withColumn("window_start", stamp(F.col("window_start")))


@register("metric_rate", "AGG-14", INCREASE + f" SELECT kind, {W} AS window_start, increase, samples, round(increase / 21600.0, 9)::DOUBLE AS rate_per_sec FROM g")
def metric_rate(spark, sf):
    done = metrics.rate(samples(spark, sf), ("kind",), "ts", "event_id", "counter", 21_600)
    return done.withColumns({"window_start": stamp(F.col("window_start")), "rate_per_sec": F.round("rate_per_sec", 9)})


@register("metric_sum_by", "AGG-15", INCREASE + " SELECT kind, sum(increase)::BIGINT AS total FROM g GROUP BY 1")
def metric_sum_by(spark, sf):
    return metrics.sum_by(_grown(spark, sf), ["kind"], "increase", "total")


@register("metric_ratio", "AGG-16", INCREASE + f" SELECT {W} AS window_start, coalesce(sum(increase) FILTER (WHERE kind = 'error'), 0)::BIGINT AS part, sum(increase)::BIGINT AS whole, round(coalesce(sum(increase) FILTER (WHERE kind = 'error'), 0) / nullif(sum(increase), 0), 9) AS ratio FROM g GROUP BY w")
def metric_ratio(spark, sf):
    done = metrics.ratio(_grown(spark, sf), ["window_start"], F.col("kind") == "error", F.lit(True), F.col("increase"))
    return done.withColumns({"window_start": stamp(F.col("window_start")), "ratio": F.round("ratio", 9)})


CENTS = "CAST(round(value * 100) AS BIGINT)"


@register("metric_avg", "AGG-17", f"SELECT event_type AS kind, sum({CENTS})::BIGINT AS total, count(*) AS n, round(sum({CENTS}) / count(*), 6) AS average FROM events GROUP BY 1")
def metric_avg(spark, sf):
    ev = events(spark, sf).withColumn("kind", F.col("event_type"))
    done = metrics.average(ev, ["kind"], F.round(F.col("value") * 100).cast("bigint"), F.lit(1).cast("bigint"))
    return done.withColumn("average", F.round("average", 6))


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
LE_ROWS = ", ".join(f"({b}::DOUBLE)" for b in BOUNDS)


@register("metric_hist_quantile", "AGG-18", f"""WITH b AS (SELECT event_type AS kind, le, count(*) FILTER (WHERE value <= le) AS c FROM events, (VALUES {LE_ROWS}, ('inf'::DOUBLE)) t(le) GROUP BY ALL),
 x AS (SELECT *, coalesce(lag(c) OVER o, 0) AS below, coalesce(lag(le) OVER o, 0) AS lo, max(c) OVER (PARTITION BY kind) * 0.95 AS rank FROM b WINDOW o AS (PARTITION BY kind ORDER BY le)),
 h AS (SELECT kind, arg_min(CASE WHEN le = 'inf'::DOUBLE THEN 250.0 ELSE lo + (le - lo) * (rank - below) / (c - below) END, le) AS q FROM x WHERE c >= rank GROUP BY kind)
 SELECT kind, round(q, 6)::DOUBLE AS quantile FROM h""")
def metric_hist_quantile(spark, sf):
    ev = events(spark, sf).withColumn("kind", F.col("event_type"))
    done = metrics.histogram_quantile(metrics.bucketed(ev, ["kind"], F.col("value"), BOUNDS), ["kind"], 0.95)
    return done.withColumn("quantile", F.round("quantile", 6))


@register("timer_percentiles", "AGG-19", """SELECT event_type AS kind, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""")
def timer_percentiles(spark, sf):
    ev = events(spark, sf).select(F.col("event_type").alias("kind"), "value")
    return metrics.percentiles(ev, ["kind"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register("metric_select", "RTE-10", "SELECT event_id, event_type AS kind FROM events WHERE regexp_full_match(event_type, '(click|sig.*)') AND user_id = 42")
def metric_select(spark, sf):
    ev = events(spark, sf)
    hit = metrics.label_matches(F.col("event_type"), "click|sig.*") & (F.col("user_id") == 42)
    return ev.filter(hit).select("event_id", F.col("event_type").alias("kind"))


@register("metric_topk", "SRT-04", "SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY failures DESC, user_id LIMIT 5")
def metric_topk(spark, sf):
    counted = events(spark, sf).filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("failures"))
    return metrics.top(counted, "failures", 5, ["user_id"])


FOR_SQL = """WITH f AS (SELECT *, value > 20 AS firing FROM events), l AS (SELECT *, firing IS DISTINCT FROM lag(firing) OVER w AS new FROM f WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
 i AS (SELECT *, sum(new::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS island FROM l),
 h AS (SELECT event_type AS kind, min(ts) AS f, max(ts) AS t, count(*) AS samples, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS held_ms FROM i WHERE firing GROUP BY event_type, island)"""


def _held(spark, sf):
    ev = events(spark, sf).withColumn("kind", F.col("event_type"))
    return metrics.held_for(ev, ("kind",), "ts", "event_id", F.col("value") > 20, 3600)


@register("alert_for", "WIN-07", FOR_SQL + f" SELECT kind, {sql_stamp('f')} AS active_from, {sql_stamp('t')} AS active_to, samples, held_ms FROM h WHERE held_ms >= 3600000")
def alert_for(spark, sf):
    return _held(spark, sf).withColumns({"active_from": stamp(F.col("active_from")), "active_to": stamp(F.col("active_to"))})


@register("alert_first", "WIN-09", FOR_SQL + f" SELECT kind, {sql_stamp('f')} AS active_from, row_number() OVER (PARTITION BY kind ORDER BY f) AS fire_no FROM h WHERE held_ms >= 3600000 QUALIFY fire_no <= 3")
def alert_first(spark, sf):
    done = metrics.ranked(_held(spark, sf), ("kind",), ("active_from",)).filter("fire_no <= 3")
    return done.select("kind", stamp(F.col("active_from")).alias("active_from"), "fire_no")


@register("recording_rules", "AGG-25", f"""SELECT {sql_stamp("make_timestamp(w * 1000)")} AS window_start, count(*) AS processed, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 9) AS failed_ratio
 FROM (SELECT *, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS w FROM events) GROUP BY w""")
def recording_rules(spark, sf):
    failed = F.count_if(F.col("event_type") == "error")
    done = metrics.recorded(events(spark, sf), "ts", 3600, [], {
        "processed": F.count(F.lit(1)), "failed": failed, "failed_ratio": F.round(failed / F.count(F.lit(1)), 9)})
    return done.withColumn("window_start", stamp(F.col("window_start")))

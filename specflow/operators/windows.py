"""Time, session, count, marker and calendar windows over event frames."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.functions import cron
from specflow.operators.ordered import previous, row_numbers, running_sum, sized

# Window states and the reasons an event is turned away.
STATES = ("PENDING", "OPENING", "OPEN", "CLOSING", "CLOSED", "ERROR")
WINDOW_CLOSED = "WINDOW_CLOSED"
TRANSITIONS = {
    "PENDING": ("OPENING",),
    "OPENING": ("OPEN", "ERROR"),
    "OPEN": ("CLOSING", "ERROR"),
    "CLOSING": ("CLOSED", "ERROR"),
    "ERROR": ("OPENING", "CLOSING"),
    "CLOSED": (),
}


def time_windows(events: DataFrame, ts: str, duration: str, slide: str | None = None, keys: tuple[str, ...] = (),
                 start: str | None = None) -> DataFrame:
    """Event count and last event per tumbling (or sliding) window and key."""
    window = F.window(ts, duration, slide or duration, start) if start else F.window(ts, duration, slide or duration)
    return summary(events.withColumn("window", window), ts, ("window", *keys)).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *keys,
        "event_count",
        "last_event_at",
    )


def summary(events: DataFrame, ts: str, keys: tuple[str, ...]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.max(ts).alias("last_event_at"))


def sessions(events: DataFrame, key: str, ts: str, unique: str, gap_ms: int, split: int | bool | None = None) -> DataFrame:
    """Sessions per key: a pause of at least the gap opens a new one."""
    at = F.unix_millis(F.col(ts))
    split = sized(events, (key,)) if split is None else split
    back = previous(events.select(key, ts, unique), (key,), (ts, unique), {"_at": at}, split)
    opens = (F.col("_at").isNull() | (at - F.col("_at") >= gap_ms)).cast("bigint")
    numbered = running_sum(back, (key,), (ts, unique), opens, "session_no", split)
    return numbered.groupBy(key, "session_no").agg(
        F.min(ts).alias("session_start"),
        F.max(ts).alias("session_last"),
        F.count(F.lit(1)).alias("event_count"),
    )


def count_windows(events: DataFrame, group: tuple[str, ...], order: tuple[str, ...], size: int, out: str = "window_no",
                  split: int | bool | None = None) -> DataFrame:
    """Every ``size`` events of a group form a window, numbered from 0."""
    return row_numbers(events, group, order, "_rn", split).withColumn(
        out, F.floor((F.col("_rn") - 1) / size).cast("bigint")
    ).drop("_rn")


def marker_windows(events: DataFrame, group: tuple[str, ...], order: tuple[str, ...], marker: Column,
                   out: str = "window_no", split: int | bool | None = None) -> DataFrame:
    """A marker event closes the window it falls in; windows are numbered from 0."""
    hit = F.coalesce(marker, F.lit(False)).cast("bigint")
    run = running_sum(events.withColumn("_m", hit), group, order, F.col("_m"), "_upto", split)
    return run.withColumn(out, F.col("_upto") - F.col("_m")).drop("_m", "_upto")


def instances(spark: SparkSession, open_cron: str, close_cron: str, start: datetime, end: datetime,
              timezone: str = "UTC", cap_minutes: int | None = None) -> DataFrame:
    """Window instances named by a pair of cron expressions that touch [start, end).

    Each opening runs to the next closing after it, at most to the cap. Openings before ``start``
    count as long as they are still open there, and a closing is looked for as far ahead as the
    calendar goes: those two ends are found first, then Spark makes a row per day between them, the
    instants of each day and the next closing of each opening. No task holds more than a day.
    """
    start, end = start.replace(tzinfo=UTC), end.replace(tzinfo=UTC)
    opening, closing = cron.Schedule(open_cron, timezone), cron.Schedule(close_cron, timezone)
    # whatever opened before the last closing is closed by now
    since = closing.upto(start) or opening.upto(start) or start
    upto = closing.after(end) or closing.upto(end) or since
    first, last = (t.astimezone(opening.zone).date() for t in (since, max(upto, end)))
    days = spark.range(first.toordinal(), last.toordinal() + 1).select(F.date_from_unix_date((F.col("id") - date(1970, 1, 1).toordinal()).cast("int")).alias("day"))
    days = days.repartition("day")
    both = cron.instants(opening, days).withColumn("opens", F.lit(True)).unionByName(cron.instants(closing, days).withColumn("opens", F.lit(False)))
    closes = F.when(~F.col("opens"), F.col("at"))
    # backwards through a day, openings first: the closings met so far are those after the opening
    later = W.partitionBy("day").orderBy(F.desc("at"), F.desc("opens")).rowsBetween(W.unboundedPreceding, -1)
    met = both.withColumn("same_day", F.min(closes).over(later))
    # a row per day, of which there are some hundred a year
    per_day = both.filter(~F.col("opens")).groupBy("day").agg(F.min("at").alias("first_close"))
    ahead = W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)
    next_days = days.join(per_day, "day", "left").select("day", F.min("first_close").over(ahead).alias("other_day"))
    opened = met.filter("opens").join(next_days, "day").select(F.col("at").alias("opened_at"), F.coalesce("same_day", "other_day").alias("closed_at"))
    if cap_minutes is not None:
        opened = capped(opened, cap_minutes)
    found = opened.filter(
        (F.col("opened_at") >= F.lit(since)) & (F.col("opened_at") < F.lit(end)) & (F.col("closed_at") > F.lit(start)))
    numbered = row_numbers(found, (), ("opened_at",), "_rn")
    return numbered.select((F.col("_rn") - 1).alias("instance_id"), "opened_at", "closed_at")


def capped(frame: DataFrame, minutes: int) -> DataFrame:
    limit = F.timestamp_millis(F.unix_millis("opened_at") + minutes * 60_000)
    return frame.withColumn("closed_at", F.least("closed_at", limit))


def assign(events: DataFrame, ts: str, frame: DataFrame) -> DataFrame:
    """Events joined to the instances open at their time (open <= ts < close).

    An instance belongs to the level whose buckets, of 2^level seconds, are the shortest that are as long as it
    is; so it touches two of them at most. Events look in their own bucket of each level
    that occurs, of which there are few. So the join is an equi-join in which an event meets only
    instances of its neighbourhood, whether they last a second or a year.
    """
    lasts = F.greatest(F.unix_millis("closed_at") - F.unix_millis("opened_at"), F.lit(1000)) / 1000
    level = F.ceil(F.log2(lasts)).cast("int")
    levelled = frame.filter("closed_at > opened_at").withColumn("_level", level)
    levels = sorted(r["_level"] for r in levelled.select("_level").distinct().collect())
    if not levels:
        levels = [0]

    def bucket(millis: Column, at_level: Column) -> Column:
        return F.floor(millis / 1000 / F.pow(F.lit(2.0), at_level)).cast("bigint")

    first, last = bucket(F.unix_millis("opened_at"), F.col("_level")), bucket(F.unix_millis("closed_at") - 1, F.col("_level"))
    spread = levelled.withColumn("_bucket", F.explode(F.sequence(first, last)))
    keyed = events.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
    keyed = keyed.withColumn("_bucket", bucket(F.unix_millis(F.col(ts)), F.col("_level")))
    hit = (F.col(ts) >= F.col("opened_at")) & (F.col(ts) < F.col("closed_at"))
    return keyed.join(spread, ["_level", "_bucket"]).filter(hit).drop("_level", "_bucket")


def with_state(frame: DataFrame, now: Column, actions_done: Column | None = None, failed: Column | None = None) -> DataFrame:
    """State of each instance at ``now``; a passed close is CLOSING until its actions are done."""
    done = actions_done if actions_done is not None else F.lit(True)
    broken = failed if failed is not None else F.lit(False)
    state = (
        F.when(broken, "ERROR")
        .when(now < F.col("opened_at"), "PENDING")
        .when(now < F.col("closed_at"), "OPEN")
        .when(~done, "CLOSING")
        .otherwise("CLOSED")
    )
    return frame.withColumn("state", state)


def transition_allowed(old: Column, new: Column) -> Column:
    allowed = F.lit(False)
    for source, targets in TRANSITIONS.items():
        if targets:
            allowed = allowed | ((old == source) & new.isin(*targets))
    return allowed


def ticks(frame: DataFrame, interval: str) -> DataFrame:
    """Recurring instants inside each window: after the opening, up to the closing."""
    at = F.explode(F.sequence("opened_at", "closed_at", F.expr(f"interval {interval}")))
    return frame.select("*", at.alias("tick_at")).filter("tick_at > opened_at and tick_at < closed_at")


def with_empty(counted: DataFrame, calendar: DataFrame, keys: list[str], counter: str = "event_count") -> DataFrame:
    """All calendar windows; those without events get a zero count."""
    zero = F.coalesce(counter, F.lit(0).cast("bigint")).alias(counter)
    rest = [c for c in counted.columns if c not in keys and c != counter]
    return calendar.join(counted, keys, "left").select(*keys, zero, *rest)


def arrival_verdict(arrival: Column, close: Column, allow_late: bool, tolerance_ms: int) -> Column:
    """ON_TIME, LATE or WINDOW_CLOSED for an event of a window that closes at ``close``."""
    limit = F.unix_millis(close) + (tolerance_ms if allow_late else 0)
    return (
        F.when(arrival < close, "ON_TIME")
        .when(F.lit(allow_late) & (F.unix_millis(arrival) <= limit), "LATE")
        .otherwise(WINDOW_CLOSED)
    )


def threshold_fires(events: DataFrame, window: tuple[str, ...], order: tuple[str, ...], threshold: int,
                    reset: bool = True, limit: int | None = None, split: int | bool | None = None) -> DataFrame:
    """The events whose arrival takes a window's count across the threshold, with the trigger number."""
    run = row_numbers(events, window, order, "running_count", split)
    crossed = F.col("running_count") % threshold == 0 if reset else F.col("running_count") == threshold
    fired = run.filter(crossed).withColumn("trigger_no", (F.col("running_count") / threshold).cast("bigint"))
    return fired if limit is None else fired.filter(F.col("trigger_no") <= limit)

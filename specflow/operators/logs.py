"""Log search: field filters, histograms, top messages and lines near an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.operators.ordered import previous, running_sum, sized


def wildcard(c: Column, pattern: str) -> Column:
    """``*`` matches any text; everything else is literal; the whole value must match."""
    body = "".join(".*" if ch == "*" else rf"\Q{ch}\E" for ch in pattern)
    return c.rlike(rf"(?s)\A{body}\z")


def phrase(c: Column, words: str) -> Column:
    return F.contains(c, F.lit(words))


def recent(logs: DataFrame, ts: str, level: str, seconds: int, limit: int, ties: list[str]) -> DataFrame:
    """Newest lines of one level within the last ``seconds`` of the log."""
    newest = logs.agg(F.max(ts)).scalar()
    near = logs.filter((F.col("level") == level) & (F.unix_millis(F.col(ts)) >= F.unix_millis(newest) - seconds * 1000))
    return near.orderBy(F.desc(ts), *ties).limit(limit)


def level_histogram(logs: DataFrame, ts: str, duration: str) -> DataFrame:
    grouped = logs.groupBy(F.window(ts, duration).alias("w"), "level").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "level", "n")


def top_messages(logs: DataFrame, limit: int, message: str = "message") -> DataFrame:
    return logs.groupBy(message).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), message).limit(limit)


def alert_spans(alerts: DataFrame, ts: str, unique: str, seconds: int, split: int | bool | None = None) -> DataFrame:
    """Alert neighbourhoods merged where they overlap: disjoint (span, from, to) rows."""
    at = F.unix_millis(F.col(ts))
    keyed = alerts.select(at.alias("_at"), F.col(unique).alias("_u"))
    split = sized(keyed, ()) if split is None else split
    back = previous(keyed, (), ("_at", "_u"), {"_was": F.col("_at")}, split)
    opens = (F.col("_was").isNull() | (F.col("_at") - F.col("_was") > 2 * seconds * 1000)).cast("bigint")
    numbered = running_sum(back, (), ("_at", "_u"), opens, "span_no", split)
    return numbered.groupBy("span_no").agg(
        (F.min("_at") - seconds * 1000).alias("from_ms"),
        (F.max("_at") + seconds * 1000).alias("to_ms"),
        F.count(F.lit(1)).alias("alerts"),
    )


def near_alerts(logs: DataFrame, ts: str, spans: DataFrame, bucket_ms: int) -> DataFrame:
    """Log lines inside a span. Spans are disjoint, so a line matches at most one of them."""
    first, last = F.floor(F.col("from_ms") / bucket_ms), F.floor(F.col("to_ms") / bucket_ms)
    spread = spans.select("*", F.explode(F.sequence(first, last)).alias("_bucket"))
    at = F.unix_millis(F.col(ts))
    keyed = logs.withColumn("_bucket", F.floor(at / bucket_ms))
    joined = keyed.join(spread, "_bucket").filter(at.between(F.col("from_ms"), F.col("to_ms")))
    return joined.drop("_bucket")


def counts_near_alerts(logs: DataFrame, alerts: DataFrame, ts: str, unique: str, seconds: int,
                       split: int | bool | None = None) -> DataFrame:
    """Per alert, how many log lines lie within +-seconds: two running counts, no line-alert pairs."""
    at = F.unix_millis(F.col(ts))
    none = F.lit(None).cast("bigint")
    marks = logs.select(at.alias("_at"), F.lit(1).alias("_kind"), F.lit(1).alias("_line"), none.alias("_alert"),
                        F.col(unique).cast("bigint").alias("_u"))
    # a low mark sorts before lines of its instant, a high mark after them
    low = alerts.select((at - seconds * 1000).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).alias("_line"),
                        F.col(unique).cast("bigint").alias("_alert"), F.col(unique).cast("bigint").alias("_u"))
    high = alerts.select((at + seconds * 1000).alias("_at"), F.lit(2).alias("_kind"), F.lit(0).alias("_line"),
                         F.col(unique).cast("bigint").alias("_alert"), F.col(unique).cast("bigint").alias("_u"))
    run = running_sum(marks.unionByName(low).unionByName(high), (), ("_at", "_kind", "_u"), F.col("_line"), "_upto", split)
    signed = F.when(F.col("_kind") == 2, F.col("_upto")).otherwise(-F.col("_upto"))
    return run.filter("_alert is not null").groupBy(F.col("_alert").alias(unique)).agg(
        F.sum(signed).alias("n_lines")
    )

"""Counters, rates, ratios, histogram quantiles and alert conditions over metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.operators.ordered import islands, previous, row_numbers, running_sum


def label_matches(label: Column, pattern: str) -> Column:
    """Regex label selector: the whole label must match."""
    return label.rlike(rf"\A(?:{pattern})\z")


def windowed(samples: DataFrame, ts: str, seconds: int, out: str = "window_start") -> DataFrame:
    at = F.floor(F.unix_seconds(F.col(ts)) / seconds) * seconds
    return samples.withColumn(out, F.timestamp_seconds(at))


def increase(samples: DataFrame, series: tuple[str, ...], ts: str, unique: str, value: str, seconds: int,
             split: int | bool | None = None) -> DataFrame:
    """Counter growth per series and window; a drop is a restart, its value is the growth."""
    cut = windowed(samples, ts, seconds)
    group = (*series, "window_start")
    lagged = previous(cut, group, (ts, unique), {"_was": F.col(value)}, split)
    grown = (
        F.when(F.col("_was").isNull(), 0)
        .when(F.col(value) < F.col("_was"), F.col(value))
        .otherwise(F.col(value) - F.col("_was"))
    )
    return lagged.groupBy(*group).agg(F.sum(grown).alias("increase"), F.count(F.lit(1)).alias("samples"))


def rate(samples: DataFrame, series: tuple[str, ...], ts: str, unique: str, value: str, seconds: int,
         split: int | bool | None = None) -> DataFrame:
    grown = increase(samples, series, ts, unique, value, seconds, split)
    return grown.withColumn("rate_per_sec", F.col("increase").cast("double") / F.lit(float(seconds)))


def sum_by(frame: DataFrame, labels: list[str], value: str, out: str) -> DataFrame:
    return frame.groupBy(*labels).agg(F.sum(value).alias(out))


def ratio(frame: DataFrame, keys: list[str], part: Column, whole: Column, value: Column, out: str = "ratio") -> DataFrame:
    """Sum over the matching samples divided by the sum over the base; null for an empty base."""
    top = F.sum(F.when(part, value).otherwise(0))
    base = F.sum(F.when(whole, value).otherwise(0))
    return frame.groupBy(*keys).agg(top.alias("part"), base.alias("whole")).withColumn(
        out, F.try_divide(F.col("part").cast("double"), F.col("whole").cast("double"))
    )


def average(frame: DataFrame, keys: list[str], total: Column, count: Column) -> DataFrame:
    grouped = frame.groupBy(*keys).agg(F.sum(total).alias("total"), F.sum(count).alias("n"))
    return grouped.withColumn("average", F.try_divide(F.col("total").cast("double"), F.col("n").cast("double")))


def bucketed(frame: DataFrame, keys: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative histogram: one row per key and upper bound, +Inf last."""
    counts = frame.groupBy(*keys).agg(
        *[F.count_if(value <= b).alias(f"_b{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("_binf")
    )
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_binf").alias("cumulative")))
    return counts.select(*keys, F.inline(F.array(*pairs)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, le: str = "le", count: str = "cumulative") -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank.

    A rank in the +Inf bucket gives the highest finite bound; the first bucket starts at 0.
    The window runs over aggregated buckets, a handful of rows per key.
    """
    ordered = W.partitionBy(*keys).orderBy(le)
    whole = W.partitionBy(*keys)
    inf = F.lit(float("inf"))
    spread = buckets.select(
        *keys,
        F.col(le).alias("_le"),
        F.col(count).cast("double").alias("_cum"),
        F.coalesce(F.lag(count).over(ordered), F.lit(0)).cast("double").alias("_below"),
        F.coalesce(F.lag(le).over(ordered), F.lit(0.0)).alias("_from"),
        F.max(F.when(F.col(le) < inf, F.col(le))).over(whole).alias("_top"),
        (F.max(count).over(whole) * F.lit(q)).alias("_rank"),
    )
    inside = F.col("_from") + (F.col("_le") - F.col("_from")) * F.try_divide(
        F.col("_rank") - F.col("_below"), F.col("_cum") - F.col("_below")
    )
    value = F.when(F.col("_le") == inf, F.col("_top")).otherwise(inside)
    hit = spread.filter(F.col("_cum") >= F.col("_rank"))
    return hit.groupBy(*keys).agg(F.min_by(value, F.col("_le")).alias("quantile"))


def percentiles(frame: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                split: int | bool | None = None) -> DataFrame:
    """Exact discrete percentiles from value counts; no key's values are gathered anywhere."""
    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running_sum(counts, tuple(keys), (value,), F.col("_n"), "_upto", split)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = run.join(totals, keys)
    # smallest value whose running count reaches ceil(q * total)
    return joined.groupBy(*keys).agg(
        F.max("_total").alias("n"),
        *[
            F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_total") * q), F.lit(1)), F.col(value))).alias(out)
            for out, q in quantiles.items()
        ],
    )


def top(frame: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The k largest rows, as one bounded top-k."""
    return frame.orderBy(F.desc(by), *ties).limit(k)


def held_for(samples: DataFrame, series: tuple[str, ...], ts: str, unique: str, firing: Column, seconds: int,
             split: int | bool | None = None) -> DataFrame:
    """Stretches over which the condition held without a break for at least ``seconds``."""
    runs = islands(samples.withColumn("_on", firing), series, (ts, unique), F.col("_on"), "_island", split)
    stretches = (
        runs.filter("_on")
        .groupBy(*series, "_island")
        .agg(F.min(ts).alias("active_from"), F.max(ts).alias("active_to"), F.count(F.lit(1)).alias("samples"))
    )
    held = F.unix_millis("active_to") - F.unix_millis("active_from")
    return stretches.withColumn("held_ms", held).filter(F.col("held_ms") >= seconds * 1000).drop("_island")


def ranked(alerts: DataFrame, group: tuple[str, ...], order: tuple[str, ...], split: int | bool | None = None) -> DataFrame:
    return row_numbers(alerts, group, order, "fire_no", split)


def recorded(samples: DataFrame, ts: str, seconds: int, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Pre-computed aggregates per step, one column per recording rule."""
    return windowed(samples, ts, seconds).groupBy("window_start", *keys).agg(*[c.alias(n) for n, c in rules.items()])

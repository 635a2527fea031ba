"""Version histories: latest, rollback and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(history: DataFrame, key: list[str], version: str) -> DataFrame:
    """Newest revision per key, by pre-aggregated max."""
    rest = [c for c in history.columns if c not in key]
    best = history.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def rollback(history: DataFrame, key: list[str], version: str, to: int, payload: list[str]) -> DataFrame:
    """A new newest revision that repeats the payload of version ``to``."""
    newest = history.groupBy(*key).agg(F.max(version).alias("_top"))
    old = history.filter(F.col(version) == to).select(*key, *payload)
    return old.join(newest, key).select(
        *key, (F.col("_top") + 1).alias(version), *payload, F.lit(to).cast("bigint").alias("restored_from")
    )


def diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """ADDED, REMOVED and CHANGED keys with both values."""
    before = old.select(*key, F.col(value).alias("old_value"), F.lit(True).alias("_o"))
    after = new.select(*key, F.col(value).alias("new_value"), F.lit(True).alias("_n"))
    change = (
        F.when(F.col("_o").isNull(), "ADDED")
        .when(F.col("_n").isNull(), "REMOVED")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "CHANGED")
    )
    joined = before.join(after, key, "full_outer").withColumn("change", change)
    return joined.filter("change is not null").select(*key, "change", "old_value", "new_value")


def page(frame: DataFrame, order: list[str | Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) under a stable order."""
    return frame.orderBy(*order).offset(number * size).limit(size)


def page_after(frame: DataFrame, key: str, after, size: int) -> DataFrame:
    """The page that follows a known last key: no rows before it are sorted or kept."""
    later = frame if after is None else frame.filter(F.col(key) > after)
    return later.orderBy(key).limit(size)

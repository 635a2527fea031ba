"""Checksums and duplicate rejection without gathering the copies of an event."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: reason given to a rejected copy.
DUPLICATE = "DUPLICATE_CHECKSUM"


def checksum(*columns: Column | str) -> Column:
    """SHA-256 over the chosen values in order, each after its length; so no two lists of values
    are spelled alike, whatever they hold, and a null differs from an empty text."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def payload_checksum(payload: Column) -> Column:
    return F.sha2(payload, 256)


def first_seen(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row per key. min_by keeps one row per key and task before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*events.columns)


#: taken off an id it leaves no negative number, and nothing above the span
LIFT, ID_SPAN = Decimal(1 << 63), Decimal(2 * 10**19)


def packed(events: DataFrame, order: list[str], event_id: str) -> Column | None:
    """(time or number, id) as one decimal in the same order, which hash aggregation can hold; None for other types."""
    kinds = dict(events.dtypes)
    whole = ("bigint", "int", "smallint", "tinyint")
    if len(order) != 2 or order[1] != event_id or kinds.get(event_id) not in whole:
        return None
    if kinds.get(order[0]) == "timestamp":
        first = F.unix_micros(order[0])
    elif kinds.get(order[0]) in ("int", "smallint", "tinyint"):
        first = F.col(order[0])
    else:
        return None
    lifted = F.col(event_id).cast("decimal(20,0)") + F.lit(LIFT).cast("decimal(20,0)")
    return (first.cast("decimal(18,0)") * F.lit(ID_SPAN).cast("decimal(20,0)") + lifted).cast("decimal(38,0)")


def winners(events: DataFrame, keys: list[str], order: list[str], event_id: str) -> DataFrame:
    """``_winner``: the id of the earliest event per key."""
    pack = packed(events, order, event_id)
    if pack is None:
        return events.groupBy(*keys).agg(F.min_by(event_id, F.struct(*order)).alias("_winner")).select("_winner")
    low = events.groupBy(*keys).agg(F.min(pack).alias("_low")).select("_low")
    lifted = F.pmod("_low", F.lit(ID_SPAN).cast("decimal(20,0)"))
    return low.select((lifted - F.lit(LIFT).cast("decimal(20,0)")).cast(dict(events.dtypes)[event_id]).alias("_winner"))


def judged(events: DataFrame, keys: list[str], order: list[str], event_id: str) -> DataFrame:
    """Every event with ``accepted`` and ``reason``; only the earliest of its copies is accepted.

    Winners are found by aggregation and marked by a join on the unique event id, so a
    checksum shared by a third of all events never lands in one task.
    """
    won = winners(events, keys, order, event_id)
    marked = events.join(won, F.col(event_id) == F.col("_winner"), "left")
    accepted = F.col("_winner").isNotNull()
    return marked.select(
        *events.columns,
        accepted.alias("accepted"),
        F.when(~accepted, F.lit(DUPLICATE)).alias("reason"),
    )


def rejected(events: DataFrame, keys: list[str], order: list[str], event_id: str) -> DataFrame:
    return judged(events, keys, order, event_id).filter(~F.col("accepted")).drop("accepted")

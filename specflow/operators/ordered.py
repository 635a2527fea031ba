"""Running sums, row numbers and previous rows that survive one huge group.

A plain window sends a whole group to one task. Here the largest group is measured
first (a pre-aggregated count). Groups that fit use the plain window. Otherwise rows
are range-partitioned by (group, order) into chunks of bounded size, windows run per
(chunk, group), and each chunk's missing start is filled from the chunks before it.
A range cut leaves at most one group open per chunk border, so the fill table has at
most one row per chunk and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.session import checkpointed, stored

LIMIT_KEY = "specflow.window.maxGroupRows"
DEFAULT_LIMIT = 5_000_000


def _limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_KEY, str(DEFAULT_LIMIT)))


def measure(df: DataFrame, group: tuple[str, ...]) -> tuple[int, int]:
    """(rows of the largest group, all rows)."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    return row["top"] or 0, row["total"] or 0


def sized(df: DataFrame, group: tuple[str, ...]) -> int | bool:
    """False when every group fits the limit, else the number of rows. Measure once, pass on as ``split``."""
    top, total = measure(df, group)
    return False if group and top <= _limit(df) else max(total, 1)


def _plain(df: DataFrame, group: tuple[str, ...], split: int | bool | None) -> tuple[bool, int]:
    if split is None:
        split = sized(df, group)
    return split is False, int(split)


def _chunks(df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], total: int) -> DataFrame:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    count = max(least, -(-total // _limit(df)))
    ranged = df.repartitionByRange(count, *group, *order).withColumn("_chunk", F.spark_partition_id())
    # the chunk number must not change between the two uses below, whatever is recomputed
    return checkpointed(ranged)


def _border_join(data: DataFrame, fill: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Left join on (chunk, group); null group values match."""
    renamed = fill.select(*[F.col(c).alias(f"_b_{c}") for c in fill.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in ("_chunk", *group)]
    joined = data.join(F.broadcast(renamed), reduce(lambda a, b: a & b, same), "left")
    return joined.drop(*[f"_b_{c}" for c in ("_chunk", *group)])


def running_sums(
    df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], values: dict[str, Column], split: int | bool | None = None
) -> DataFrame:
    """Inclusive running sums, one per output name; ``order`` must be unique within a group."""
    plain, total = _plain(df, group, split)
    if plain:
        over = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(value).over(over) for out, value in values.items()})
    names = list(values)
    data = _chunks(df.withColumns({f"_v_{n}": values[n] for n in names}), group, order, total)
    inside = W.partitionBy("_chunk", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = data.groupBy("_chunk", *group).agg(*[F.sum(f"_v_{n}").alias(f"sum_{n}") for n in names])
    chunk_no = F.row_number().over(W.partitionBy(*group).orderBy("_chunk"))
    fill = totals.select(
        "_chunk", *group, chunk_no.alias("nth"), *[F.sum(f"sum_{n}").over(before).alias(f"prefix_{n}") for n in names]
    ).filter("nth > 1")
    joined = _border_join(data.withColumns({f"_run_{n}": F.sum(f"_v_{n}").over(inside) for n in names}), fill, group)
    zero = F.lit(0)
    sums = {
        n: F.when(F.coalesce(f"_b_prefix_{n}", f"_run_{n}").isNotNull(),
                  F.coalesce(f"_b_prefix_{n}", zero) + F.coalesce(f"_run_{n}", zero))
        for n in names
    }
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *[v.alias(n) for n, v in sums.items()])


def running_sum(
    df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], value: Column, out: str, split: int | bool | None = None
) -> DataFrame:
    return running_sums(df, group, order, {out: value}, split)


def row_numbers(
    df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], out: str = "rn", split: int | bool | None = None
) -> DataFrame:
    """1-based place within the group; with no group, within the whole frame."""
    return running_sum(df, group, order, F.lit(1).cast("bigint"), out, split)


def previous(
    df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], columns: dict[str, Column], split: int | bool | None = None
) -> DataFrame:
    """Values of the row before, per group; null on the first row."""
    plain, total = _plain(df, group, split)
    if plain:
        over = W.partitionBy(*group).orderBy(*order)
        return df.withColumns({out: F.lag(value).over(over) for out, value in columns.items()})
    pack = F.struct(*[v.alias(out) for out, v in columns.items()])
    data = _chunks(df.withColumn("_v", pack), group, order, total)
    inside = W.partitionBy("_chunk", *group).orderBy(*order)
    lasts = data.groupBy("_chunk", *group).agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    across = W.partitionBy(*group).orderBy("_chunk")
    fill = lasts.select("_chunk", *group, F.lag("_last").over(across).alias("prior")).filter("prior is not null")
    lagged = data.withColumn("_lag", F.lag("_v").over(inside))
    joined = _border_join(lagged, fill, group)
    taken = F.coalesce("_lag", "_b_prior")
    return joined.select(*df.columns, *[taken.getField(out).alias(out) for out in columns])


def islands(
    df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], state: Column, out: str = "island",
    split: int | bool | None = None,
) -> DataFrame:
    """Numbers the maximal runs of equal ``state`` per group, from 1."""
    split = sized(df, group) if split is None else split
    marked = previous(df.withColumn("_state", state), group, order, {"_was": F.col("_state")}, split)
    new = (~F.col("_state").eqNullSafe(F.col("_was"))).cast("bigint")
    return running_sum(marked, group, order, new, out, split).drop("_state", "_was")


#: entries that are composed in one list; bounds what a task gathers
FAN = 64


def _composed(table: Column, states: int) -> Column:
    """Transition tables in order, as one: for each state before the first the state after the last."""
    start = F.array(*[F.lit(s).cast("tinyint") for s in range(states)])
    return F.aggregate(table, start, lambda now, one: F.transform(now, lambda s: F.get(one["table"], s.cast("int"))))


def carried_states(df: DataFrame, group: tuple[str, ...], nth: str, table: str, states: int, out: str = "state") -> DataFrame:
    """The state in which each row of a group begins, when the first row begins in state 0.

    ``nth`` numbers a group's rows from 0 without gaps; ``table`` (array of tinyint) has for each
    state before the row the state after it. Composing tables is associative, so it is done in
    parallel: ``FAN`` rows make one row of the level above until a group is a single row, then
    the states go down the same levels. No list is longer than ``FAN``, whatever a group's size.
    """
    key, at, up = ["_k" + c for c in group], F.col("_nth"), F.floor(F.col("_nth") / FAN).cast("bigint")
    level = df.select(*[F.col(c).alias(k) for c, k in zip(group, key)], F.col(nth).alias("_nth"), F.col(table).alias("table"))
    members = F.array_sort(F.collect_list(F.struct(at.alias("nth"), "table")))
    levels = [level]
    while levels[-1].filter(at > 0).limit(1).count():
        rows = levels[-1].groupBy(*key, up.alias("_up")).agg(members.alias("_rows"))
        levels.append(stored(rows.select(*key, F.col("_up").alias("_nth"), "_rows", _composed(F.col("_rows"), states).alias("table")), "states"))
    begins = levels[-1].select(*key, at, F.lit(0).cast("tinyint").alias("_begins"))
    for rows in reversed(levels[1:]):
        first = F.struct(F.col("_begins").alias("now"), F.array().cast("array<struct<nth:bigint,state:tinyint>>").alias("seen"))
        walked = F.aggregate("_rows", first, lambda acc, one: F.struct(
            F.get(one["table"], acc["now"].cast("int")).alias("now"),
            F.concat(acc["seen"], F.array(F.struct(one["nth"].alias("nth"), acc["now"].alias("state")))).alias("seen")))
        held = rows.select(*key, at, "_rows").join(begins, [*key, "_nth"])
        begins = held.select(*key, F.inline(walked["seen"])).select(*key, F.col("nth").alias("_nth"), F.col("state").alias("_begins"))
    return begins.select(*[F.col(k).alias(c) for c, k in zip(group, key)], F.col("_nth").alias(nth), F.col("_begins").alias(out))

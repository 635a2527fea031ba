"""Span tables: search, tree depth, summaries and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.session import stored


def search(spans: DataFrame, operation: str | None = None, min_ms: float | None = None,
           tags: dict[str, str] | None = None, since=None) -> DataFrame:
    """Spans by operation, least duration, tag values and lookback."""
    found = spans
    if operation is not None:
        found = found.filter(F.col("operation") == operation)
    if min_ms is not None:
        found = found.filter(F.col("duration_ms") >= min_ms)
    for key, value in (tags or {}).items():
        found = found.filter(F.element_at("tags", key) == value)
    if since is not None:
        found = found.filter(F.col("started_at") >= since)
    return found


def summary(spans: DataFrame) -> DataFrame:
    """Per trace: spans, errors, root duration and the slowest span (first name on ties)."""
    slow = F.max_by("span_id", F.struct(F.col("duration_ms"), F.col("span_id")))
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(F.col("is_error")).alias("error_count"),
        F.sum(F.when(F.col("parent_id").isNull(), F.col("duration_ms")).otherwise(0)).alias("total_ms"),
        slow.alias("slowest_span"),
    )


def with_parent(spans: DataFrame) -> DataFrame:
    parents = spans.select(
        F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("operation").alias("parent_operation")
    )
    hit = (F.col("trace_id") == F.col("_t")) & (F.col("parent_id") == F.col("_s"))
    return spans.join(parents, hit, "left").drop("_t", "_s")


#: one span in so many is kept for the next level; at most so many spans are followed without levels
KEEP, FOLLOWED = 4, 1_000_000


def _kept(trace: str, span: str, level: int) -> Column:
    """The same choice for a span and for a pointer at it."""
    return F.pmod(F.xxhash64(trace, span, F.lit(level)), F.lit(KEEP)) == 0


def _jumped(far: DataFrame, moving: Column, spans: int) -> DataFrame:
    """Pointers whose reach doubles each round, until none is ``moving``; those that lead nowhere drop out of the join."""
    while True:
        above = far.selectExpr("trace_id", "span_id AS up", "up AS further", "steps AS more")
        # stored rows look small by their files, and the driver would gather them
        going = far.filter(moving).hint("merge").join(above, ["trace_id", "up"])
        moved = going.selectExpr("trace_id", "span_id", "further AS up", "steps + 1 + more AS steps")
        far = stored(far.filter(~moving).unionByName(moved), "depth")
        left = far.filter(moving).agg(F.count(F.lit(1)).alias("n"), F.max("steps").alias("steps")).first()
        # a path longer than the number of spans runs in a ring
        if not left["n"] or left["steps"] > spans:
            return far.filter(~moving)


def _depths(far: DataFrame, spans: int, level: int = 0) -> DataFrame:
    """trace_id, span_id and steps to the root, of spans that have one."""
    rows = far.count()
    if rows <= FOLLOWED or level > 40:
        return _jumped(far, F.col("up").isNotNull(), spans).filter("up IS NULL").select("trace_id", "span_id", "steps")
    kept, resting = _kept("trace_id", "span_id", level), F.col("up").isNull() | _kept("trace_id", "up", level)
    near = _jumped(far, ~resting, spans)
    # a pointer of a kept span at itself is a ring
    roots = _depths(stored(near.filter(kept & ~F.col("up").eqNullSafe(F.col("span_id"))), "depth"), spans, level + 1)
    own = near.filter(~kept)
    below = own.filter("up IS NOT NULL").hint("merge").join(roots.selectExpr("trace_id", "span_id AS up", "steps AS more"), ["trace_id", "up"])
    found = own.filter("up IS NULL").select("trace_id", "span_id", "steps").unionByName(
        below.selectExpr("trace_id", "span_id", "steps + 1 + more AS steps"))
    return stored(found.unionByName(roots), "depth")


def with_depth(spans: DataFrame) -> DataFrame:
    """Depth below the root, by pointers whose reach doubles each round: a chain of n spans takes log n rounds.

    Many spans are followed only up to the next of a quarter of them, which a few rounds reach; these
    are treated alike, and the others take their depth. So the work grows with the spans.
    Each round keeps ids only and is stored, so lineage stays flat. Spans whose parent chain
    does not reach a root keep a null depth; that includes rings, whose pointers reach no end.
    """
    # a pointer is compared and dealt as the id that it names
    ids = spans.select("trace_id", "span_id", F.col("parent_id").cast(spans.schema["span_id"].dataType).alias("up")).distinct()
    # up: the ancestor ``steps`` levels above, null once the root is reached
    far = stored(ids.selectExpr("trace_id", "span_id", "up", "0L AS steps"), "depth")
    placed = _depths(far, far.count()).selectExpr("trace_id", "span_id", "cast(steps AS int) AS depth")
    return spans.join(placed, ["trace_id", "span_id"], "left")


def compare(spans: DataFrame, left: str, right: str) -> DataFrame:
    """Duration per operation in two traces side by side."""
    both = spans.filter(F.col("trace_id").isin(left, right))
    return both.groupBy("operation").agg(
        F.sum(F.when(F.col("trace_id") == left, F.col("duration_ms")).otherwise(0)).alias("left_ms"),
        F.sum(F.when(F.col("trace_id") == right, F.col("duration_ms")).otherwise(0)).alias("right_ms"),
    ).withColumn("diff_ms", F.col("left_ms") - F.col("right_ms"))


def compare_extremes(spans: DataFrame) -> DataFrame:
    """Slowest against fastest trace, found and compared without leaving the cluster."""
    totals = summary(spans).select("trace_id", "total_ms")
    slow = totals.agg(F.max_by("trace_id", F.struct("total_ms", "trace_id"))).scalar()
    fast = totals.agg(F.min_by("trace_id", F.struct("total_ms", "trace_id"))).scalar()
    marked = spans.select("operation", "duration_ms", (F.col("trace_id") == slow).alias("_slow"), (F.col("trace_id") == fast).alias("_fast"))
    return marked.filter("_slow or _fast").groupBy("operation").agg(
        F.sum(F.when(F.col("_slow"), F.col("duration_ms")).otherwise(0)).alias("slow_ms"),
        F.sum(F.when(F.col("_fast"), F.col("duration_ms")).otherwise(0)).alias("fast_ms"),
    ).withColumn("diff_ms", F.col("slow_ms") - F.col("fast_ms"))

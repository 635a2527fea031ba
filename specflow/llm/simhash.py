"""SimHash near-duplicates: a grid over segment bit counts, then exact bit distances.

A fingerprint of 64 bits is cut into 32 segments of two bits; its embedding holds the number
of set bits of each segment. The Manhattan distance of two embeddings is never above the bit
distance of their fingerprints, so it is a lower bound. The embedding is written as a unary
code (0, 1, 2 as 00, 01, 11), in which it is the number of differing code bits.

The axes are dealt to ``distance + 2`` groups. A pair within the distance has two groups at
least in which the embeddings are equal, so it meets in a grid cell of some pair of groups.
Within a cell a search starts from the first fingerprint, takes all unreached ones within reach,
goes on from those, and ties all it has found to the first, so a cell of m fingerprints gives
under m ties, never its pairs. Cells of more than
``per_cell`` fingerprints are dealt as pairs of chunks. Equal fingerprints are one node.
Components come from alternating large-star and small-star rounds.

Defined cases: a null or empty text has fingerprint zero, which links like any other; copies
of a row share fingerprint and component; rows with a null id belong to their component, whose
id is the smallest that is not null (null if there is none). A bit set in just half of the shingles
is 0. Texts of any length are read whole. An empty table gives an
empty result; added columns change their names where the table has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from specflow.llm.common import LOWER, bounded_batches, fresh, frozen, slices

SEED = 42
#: fingerprints that one task compares in one cell
PER_CELL = 20_000
_EVEN = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, width: int) -> int:
    """Signed 64-bit SimHash of the word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(width, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([xxh64_intdigest(line[s:e], SEED) for s, e in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 10_000):
        bits = np.unpackbits(hashes[part : part + 10_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """id and fingerprint of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in slices(batches, text):
            found = pa.array([fingerprint(row, width) for row in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(id), found], [id, "_print"])

    schema = T.StructType([df.schema[id], T.StructField("_print", T.LongType())])
    return bounded_batches(df.select(id, text)).mapInArrow(each, schema)


def embed(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, as a unary code."""
    high, low = (prints >> np.uint64(1)) & _EVEN, prints & _EVEN
    return (high | low) | ((high & low) << np.uint64(1))


def grids(distance: int) -> list[np.uint64]:
    """Code bits of every pair of axis groups."""
    groups = [0] * (distance + 2)
    for axis in range(32):
        groups[axis * len(groups) // 32] |= 3 << (2 * axis)
    return [np.uint64(a | b) for a, b in combinations(groups, 2)]


def cells(prints: DataFrame, distance: int) -> DataFrame:
    """A row for each fingerprint and grid: grid, cell, _print."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = grids(distance)
        for batch in batches:
            column = batch.column("_print").to_numpy()
            code = embed(column.view(np.uint64))
            for grid, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(column), grid, np.int32)), pa.array((code & mask).view(np.int64)), pa.array(column)],
                    ["grid", "cell", "_print"],
                )

    return prints.select("_print").mapInArrow(each, "grid int, cell bigint, _print bigint")


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(first, other) for the fingerprints of a cell that reach each other within the distance; ``prints`` rise."""
    codes = embed(prints)
    links, waiting, left = [], [], np.arange(len(prints))
    first = 0
    while len(left):
        if waiting:
            at = waiting.pop()
        else:
            first = at = left[0]
            left = left[1:]
        near = np.bitwise_count(codes[left] ^ codes[at]) <= distance
        if near.any():
            near[near] = np.bitwise_count(prints[left[near]] ^ prints[at]) <= distance
            reached = left[near]
            links += [(first, other) for other in reached.tolist()]
            waiting += reached.tolist()
            left = left[~near]
    return links


def links(prints: DataFrame, distance: int, per_cell: int) -> DataFrame:
    """Pairs a, b of fingerprints that links join, enough of them to join all that belongs together."""
    placed = cells(prints, distance)
    sizes = placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"))
    large = frozen(
        sizes.filter(F.col("n") > per_cell).withColumn("chunks", F.expr(f"cast(ceil(2 * n / {per_cell}) as int)")).drop("n"),
        "cells",
    )
    chunk = F.expr("cast(pmod(xxhash64(_print), chunks) as int)")
    # a chunk meets every other chunk of its cell
    pairs = F.expr("transform(sequence(0, chunks - 1), x -> least(x, chunk) * chunks + greatest(x, chunk))")
    dealt = placed.join(large, ["grid", "cell"], "left").withColumn("chunk", chunk)
    dealt = dealt.select("grid", "cell", F.explode(F.when(F.isnull("chunks"), F.array(F.lit(0))).otherwise(pairs)).alias("deal"), "_print")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def linked(block: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((block[1:, :3] != block[:-1, :3]).any(axis=1)) + 1
            found: list[tuple[int, int]] = []
            for s, e in zip(np.r_[0, new].tolist(), np.r_[new, len(block)].tolist()):
                if e - s > 1:
                    members = np.unique(block[s:e, 3])
                    found += [(int(members[a]), int(members[b])) for a, b in forest(members.view(np.uint64), distance)]
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            block = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            block = np.concatenate([*kept, block])
            last = np.flatnonzero((block[:, :3] != block[-1, :3]).any(axis=1))
            done = int(last[-1]) + 1 if len(last) else 0
            kept = [block[done:]]
            if done:
                yield linked(block[:done])
        if kept and len(kept[0]):
            yield linked(kept[0])

    together = dealt.repartition("grid", "cell", "deal").sortWithinPartitions("grid", "cell", "deal")
    return together.mapInArrow(each, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for every node that has a link."""

    def smallest(rows: DataFrame) -> DataFrame:
        return frozen(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "smallest")

    def are_stars(rows: DataFrame) -> bool:
        """Every node hangs on one other, which hangs on none."""
        if not rows.groupBy("a").count().filter("count > 1").isEmpty():
            return False
        return rows.select(F.col("b").alias("a")).join(rows.select("a"), "a", "left_semi").isEmpty()

    edges = frozen(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    while not are_stars(edges):
        both = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
        star = both.join(smallest(both), "u").filter("v > u").selectExpr("v AS a", "m AS b")
        down = frozen(star.filter("a <> b").distinct(), "large").selectExpr("a AS u", "b AS v")
        least = down.join(smallest(down), "u")
        star = least.selectExpr("v AS a", "m AS b").union(least.selectExpr("u AS a", "m AS b"))
        edges = frozen(star.filter("a <> b").distinct(), "small")
    roots = edges.selectExpr("b AS node", "b AS root").distinct()
    return edges.selectExpr("a AS node", "b AS root").union(roots)


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, per_cell: int = PER_CELL,
) -> DataFrame:
    """id, ``fingerprint`` (signed 64 bit) and ``component_id``, the smallest id of the row's component."""
    out_print, out_id = fresh(df.select(id), "fingerprint", "component_id")
    rows = frozen(fingerprints(df, id, text, width), "prints")
    nodes = frozen(rows.groupBy("_print").agg(F.min(id).alias("_least")), "nodes")
    joined = frozen(components(links(nodes, distance, per_cell)), "components")
    members = nodes.join(joined, nodes["_print"] == joined["node"])
    least = members.groupBy("root").agg(F.min("_least").alias("_of_root"))
    of_node = joined.join(least, "root").select("node", "_of_root")
    known = nodes.join(of_node, nodes["_print"] == of_node["node"], "left")
    known = frozen(
        known.select("_print", F.when(F.isnull("node"), F.col("_least")).otherwise(F.col("_of_root")).alias("_least")), "known"
    )
    return rows.join(known, "_print").select(id, F.col("_print").alias(out_print), F.col("_least").alias(out_id))


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The rows with the smallest id of every component; of copies of that row one stays."""
    row, key = fresh(df, "_row", "_key")
    rows = frozen(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.struct(id, row).alias(key), F.col(text))
    found = near_duplicates(keyed, key, text, width, distance)
    # the rows that go are fewer than those that stay; the planner broadcasts them when their file is small
    gone = frozen(found.filter(F.col(f"{key}.{row}") != F.col(f"component_id.{row}")).select(F.col(f"{key}.{row}").alias(row)), "gone")
    return rows.join(gone, row, "left_anti").select(*df.columns)

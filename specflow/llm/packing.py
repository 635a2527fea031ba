"""Harmonic packing of documents into training sequences.

A document's ids are cut so that pieces nearly fill a reciprocal of the capacity: full
sequences first, then from the rest a part of exactly capacity // (j + 1) ids as long as the
rest would waste more than 1/``slack`` of itself in its class. Class j holds the
lengths of which exactly j fit, so a bin of class j takes j pieces whatever their order, and
every task fills the bins of its own stretch of the class. What does not fill a last bin,
under j pieces a class, is packed first-fit by falling length.

Defined cases: an empty or null text is its end id alone; rows are packed as they come, so
copies and rows with the same or no id are packed each on its own; pieces equally long keep the order
of their rows. Texts of any length are packed whole. An empty table
gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specflow.llm.common import bounded_batches, numbered, slices, vocabulary, word_pieces

CAPACITY = 2048
END = 1
SLACK = 32


def cut(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        fit = capacity // rest
        if (capacity // fit - rest) * slack <= rest:
            pieces.append(rest)
            break
        part = capacity // (fit + 1)
        pieces.append(part)
        rest -= part
    return pieces


def document_pieces(df: DataFrame, id: str, text: str, path: str, capacity: int, slack: int, with_ids: bool) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    end = END.to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_pieces(path)
        for part, rows in slices(batches, text):
            places, starts, lengths, sums, totals, bodies = [], [], [], [], [], []
            for i, ids in enumerate(tokens.encode(rows)):
                ids += end
                start = 0
                for length in cut(len(ids) // 4, capacity, slack):
                    body = ids[4 * start : 4 * (start + length)]
                    places.append(i)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(crc32(body))
                    totals.append(len(ids) // 4)
                    bodies.append(body)
                    start += length
            columns = [part.column(id).take(pa.array(places, pa.int32()))]
            columns += [pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals)]
            columns += [pa.array(bodies, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    fields = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType([df.schema[id], *fields])
    return bounded_batches(df.select(id, text)).mapInArrow(each, schema)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each length; lengths fall."""
    room: list[int] = []
    filled: list[int] = []
    out = []
    for length in lengths:
        bin = next((b for b, free in enumerate(room) if free >= length), len(room))
        if bin == len(room):
            room.append(capacity)
            filled.append(0)
        out.append((bin, filled[bin]))
        room[bin] -= length
        filled[bin] += 1
    return out


def pack(
    df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None,
    capacity: int = CAPACITY, slack: int = SLACK, with_ids: bool = False,
) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``; ``with_ids`` carries the ids (little-endian unsigned 32 bit)."""
    spark = df.sparkSession
    path = path or vocabulary("word_bpe_49k.json")
    pieces = document_pieces(df, id, text, path, capacity, slack, with_ids)
    sorted_in = pieces.withColumn("_class", F.expr(f"cast({capacity} div length as int)"))
    rows, sizes = numbered(sorted_in, "pieces", "_class", "_nth")
    # one row for each class, of which there are at most twice the root of the capacity
    base, plan = 0, []
    for fit, count in sorted((r["_class"], r["rows"]) for r in sizes.collect()):
        plan.append((fit, count // fit, base))
        base += count // fit
    classes = spark.createDataFrame(plan, "_class int, _full bigint, _base bigint")
    rows = rows.join(F.broadcast(classes), "_class").withColumn("_bin", F.expr("_nth div _class"))
    full = rows.filter("_bin < _full").selectExpr("*", "_base + _bin AS sequence_id", "_nth % _class AS _place")

    def pack_rest(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "_nth"], ascending=[False, True])
        placed = first_fit(rest["length"].tolist(), capacity)
        return pd.DataFrame({
            "_class": rest["_class"], "_nth": rest["_nth"],
            "sequence_id": [base + b for b, _ in placed], "_place": [p for _, p in placed],
        })

    # under j pieces of each class: a number that the capacity bounds, whatever the input
    rest = rows.filter("_bin >= _full")
    placed = rest.select("_class", "_nth", "length", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(
        pack_rest, "_class int, _nth bigint, sequence_id bigint, _place bigint"
    )
    rest = rest.join(placed, ["_class", "_nth"])
    names = [*pieces.columns, "sequence_id", "_place"]
    before = W.partitionBy("sequence_id").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return full.select(names).unionByName(rest.select(names)).withColumn("offset", offset).drop("_place")

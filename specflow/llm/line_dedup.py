"""Line dedup: lines that many documents share are dropped from all of them.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys are
compared by a 128-bit hash. Distinct documents are counted per key over all rows, and the
other lines are put together again in their order. Up to ``BROADCAST_KEYS`` shared keys are counted
and then broadcast, so texts stay where they are; beyond that the keys that each row loses
are joined to it.

Defined cases: a null or empty text is one empty line and comes back as an empty text;
rows with the same id are one document, null ids together are one document; copies of a
row lose the same lines; a text that loses all lines becomes empty. Texts and lines of any length
are taken whole. An empty table gives
an empty result; added columns change their names where the table has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from specflow.llm.common import LOWER, SPACE, bounded_batches, fresh, frozen, slices

#: shared keys that are broadcast, 16 bytes each; more are joined
BROADCAST_KEYS = 200_000


def key_hashes(text: bytes, least: int) -> list[bytes | None]:
    """Hash of each line's key; none for keys of under ``least`` code points."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).translate(LOWER)
        long = len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)
        out.append(xxh3_128_digest(key) if long else None)
    return out


def line_keys(df: DataFrame, text: str, keep: str, least: int) -> DataFrame:
    """``keep`` and the hash of every distinct line key of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in slices(batches, text):
            places, hashes = [], []
            for i, row in enumerate(rows):
                found = {h for h in key_hashes(row, least) if h}
                places += [i] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays(
                [part.column(keep).take(pa.array(places, pa.int32())), pa.array(hashes, pa.binary())], [keep, "_key"]
            )

    schema = T.StructType([df.schema[keep], T.StructField("_key", T.BinaryType())])
    return bounded_batches(df.select(keep, text)).mapInArrow(each, schema)


def drop_shared_lines(
    df: DataFrame, id: str = "doc_id", text: str = "text", documents: int = 10, least: int = 1, broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """The rows with shared lines dropped from the text, and ``n_lines`` and ``n_dropped``.

    Shared are keys of ``least`` code points or more, found in ``documents`` documents or more.
    """
    row, shared, n_lines, n_dropped = fresh(df, "_row", "_shared", "n_lines", "n_dropped")
    counts = line_keys(df, text, id, least).groupBy("_key").agg(F.count_distinct(F.struct(F.col(id))).alias("n"))
    common = frozen(counts.filter(F.col("n") >= documents).select("_key"), "lines")
    if common.count() <= broadcast_keys:
        keys = frozenset(k.as_py() for k in common.toArrow().column("_key"))
        everywhere, joined = df.sparkSession.sparkContext.broadcast(keys), df.withColumn(shared, F.lit(None).cast("string"))
    else:
        # equal hashes of different rows only join sets of shared keys, which drops nothing more
        keyed = df.withColumn(row, F.xxhash64(F.col(id), F.col(text)))
        per_row = line_keys(keyed, text, row, least).join(common, "_key", "left_semi")
        lost = frozen(per_row.groupBy(row).agg(F.array_join(F.collect_set(F.hex("_key")), "").alias(shared)), "lost")
        everywhere, joined = None, keyed.join(lost, row, "left").drop(row)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for part, rows in slices(batches, text):
            out, total, dropped = [], [], []
            for body, joined_keys in zip(rows, part.column(shared).to_pylist()):
                lines = body.split(b"\n")
                total.append(len(lines))
                gone = everywhere.value if everywhere else frozenset()
                if joined_keys:
                    raw = bytes.fromhex(joined_keys)
                    gone = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                if gone:
                    lines = [line for line, key in zip(lines, key_hashes(body, least)) if key not in gone]
                dropped.append(total[-1] - len(lines))
                out.append(b"\n".join(lines))
            columns = [part.column(c) for c in names]
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            columns += [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, n_lines, n_dropped])

    names = df.columns
    schema = T.StructType([
        *df.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())
    ])
    return bounded_batches(joined).mapInArrow(rebuild, schema)

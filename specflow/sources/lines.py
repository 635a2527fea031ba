"""Text lines with exact per-file numbering and no shuffle of the lines themselves.

Every file split is numbered locally: ``monotonically_increasing_id`` counts rows in
scan order, so a row's place in its split is its id minus the smallest id of the split.
One aggregation gives (smallest id, line count) per split; running totals over that
small table give each split's offset, and a join on the split adds it to the lines.

The two scans must cut the files alike. Spark cuts by the cores it has at each scan, so
``read_lines`` pins that number for the session; a line that still finds no facts of its
split, or lies outside them, stops the job.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.functions.text import is_blank
from specflow.session import stored

PIN = "spark.sql.files.minPartitionNum"
MOVED = "The files were cut differently by two scans; lines cannot be numbered. Keep " + PIN + " and the files unchanged."


def pin_splits(spark: SparkSession) -> None:
    """From now on files are cut for as many tasks as now, whatever executors come and go."""
    if spark.conf.get(PIN, None) is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set(PIN, str(cores))


def loadable(file_path: str) -> str:
    """A path to load from a ``_metadata.file_path``, which is spelled as a URI; nothing in it is a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(file_path))


def file_heads(spark: SparkSession, paths: list[str], line_sep: str, glob: str | None = None, least: int = 0) -> DataFrame:
    """_file and _head: the text before the first separator, or more where that has under ``least`` characters.

    The bytes are not decoded.
    """
    lines = text_lines(spark, paths, {"lineSep": line_sep}, glob).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), "value")
    early = _numbered(lines).filter("_split = 0").select("_file", "value", "_id")
    first = stored(early.groupBy("_file").agg(F.min_by("value", "_id").alias("_head"), F.min("_id").alias("_first")), "heads")
    short = first.filter(F.length("_head") < least)
    if not least or short.isEmpty():
        return first.drop("_first")
    # every line takes a separator at least
    lines_needed = -(-least // len(line_sep))
    near = early.join(short.select("_file", "_first"), "_file").filter(F.col("_id") - F.col("_first") <= lines_needed)
    joined = near.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("_id", "value"))).alias("_rows"))
    longer = joined.select("_file", F.array_join(F.transform("_rows", lambda r: r["value"]), line_sep).alias("_head"))
    return first.filter(F.length("_head") >= least).drop("_first").unionByName(longer)


def files_by(facts: DataFrame, *columns: str) -> dict[tuple, list[str] | None]:
    """Loadable paths of the files by the values of some columns; None stands for all files, where these have one value.

    So paths are listed on the driver only where a folder is mixed, as reading files by name needs it.
    """
    kinds = [tuple(r) for r in facts.select(*columns).distinct().collect()]
    if len(kinds) < 2:
        return {kind: None for kind in kinds}
    found: dict[tuple, list[str] | None] = {kind: [] for kind in kinds}
    for row in facts.select("_file", *columns).toLocalIterator():
        found[tuple(row[c] for c in columns)].append(loadable(row["_file"]))
    return found


def charset_of(encoding: str) -> str | None:
    """Canonical name, None for UTF-8 and ASCII."""
    name = encoding.upper().replace("_", "-")
    if name in ("UTF-8", "UTF8", "US-ASCII", "ASCII"):
        return None
    return {"LATIN1": "ISO-8859-1", "ISO8859-1": "ISO-8859-1", "LATIN-1": "ISO-8859-1", "UTF16": "UTF-16"}.get(name, name)


def by_byte_order(spark: SparkSession, paths: list[str], glob: str | None) -> dict[str, list[str] | None]:
    """Files of UTF-16 by the order that the mark at the start of each tells; without one the high byte is first."""
    mark = F.hex(F.substring(F.col("_head").cast("binary"), 1, 2))
    order = F.when(mark == "FFFE", "UTF-16LE").otherwise("UTF-16BE")
    return {k[0]: v for k, v in files_by(file_heads(spark, paths, "\n", glob).withColumn("_order", order), "_order").items()}


def decoded(lines: DataFrame, charset: str) -> DataFrame:
    """``value`` from the bytes of a charset; bytes it does not know become the replacement mark."""
    conf = lines.sparkSession.conf
    switches = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {k: conf.get(k, "false") for k in switches}
    try:
        # both are read when the expression is made, so they need not stay
        for k in switches:
            conf.set(k, "true")
        text = F.decode(F.col("value").cast("binary"), charset)
        return lines.withColumn("value", F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r$", ""))
    finally:
        for k, v in before.items():
            conf.set(k, v)


def read_lines(
    spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", line_sep: str | None = None,
    glob: str | None = None, sizes: bool = False,
) -> DataFrame:
    """Columns: _file, _split, _raw, _id. Lines are cut as bytes, then decoded; blank lines are lines.

    With ``sizes`` also _bytes of the line and _file_bytes.
    """
    pin_splits(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    charset = charset_of(encoding)
    if charset != "UTF-16":
        return _numbered(_lines(spark, paths, charset, line_sep, glob, sizes))
    orders = by_byte_order(spark, paths, glob) or {"UTF-16BE": None}
    parts = [_lines(spark, own or paths, order, line_sep, None if own else glob, sizes) for order, own in sorted(orders.items())]
    return _numbered(reduce(DataFrame.unionByName, parts))


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_id", F.monotonically_increasing_id())


def text_lines(spark: SparkSession, paths: list[str], options: dict[str, str], glob: str | None) -> DataFrame:
    """The text source over all files below the paths."""
    # folder names are not data here, even when they look like partitions
    options = {**options, "recursiveFileLookup": "true", **({"pathGlobFilter": glob} if glob else {})}
    return spark.read.format("text").options(**options).load(paths)


def _lines(spark: SparkSession, paths: list[str], charset: str | None, line_sep: str | None, glob: str | None, sizes: bool) -> DataFrame:
    options = {}
    wide = charset is not None and charset.startswith(("UTF-16", "UTF-32"))
    if line_sep and line_sep != "\n" or wide:
        options["lineSep"] = line_sep or "\n"
    if charset:
        # the separator's bytes; the text itself is decoded below
        options["encoding"] = charset
    asked = [F.octet_length("value").cast("bigint").alias("_bytes"), F.col("_metadata.file_size").alias("_file_bytes")] if sizes else []
    lines = text_lines(spark, paths, options, glob).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), *asked
    )
    if charset:
        lines = decoded(lines, charset)
    return lines.select("_file", "_split", F.col("value").alias("_raw"), *(["_bytes", "_file_bytes"] if sizes else []))


def split_table(lines: DataFrame, first_line: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per file split: first id, lines, filled lines and those before the split; its first line on demand.

    ``more`` are further figures of a split, found in the same scan.

    ``_ffirst`` is the id that the split's first filled line gets when blank lines are dropped
    before ids are given: ids restart with each task, whose number is in the upper bits.
    """
    figures = [
        F.min("_id").alias("_first"),
        F.count(F.lit(1)).alias("_lines"),
        F.count_if(~is_blank(F.col("_raw"))).alias("_filled"),
    ]
    if first_line:
        figures.append(F.min_by("_raw", "_id").alias("_line0"))
    figures += [figure.alias(name) for name, figure in (more or {}).items()]
    counted = lines.groupBy("_file", "_split").agg(*figures)
    task = F.shiftright("_first", 33)
    of_file = W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    of_task = W.partitionBy(task).orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return stored(
        counted.select(
            "*",
            F.coalesce(F.sum("_lines").over(of_file), zero).alias("_offset"),
            F.coalesce(F.sum("_filled").over(of_file), zero).alias("_filled_before"),
            (F.shiftleft(task, 33) + F.coalesce(F.sum("_filled").over(of_task), zero)).alias("_ffirst"),
        ),
        "splits",
    )


def attach(lines: DataFrame, splits: DataFrame, *columns: str) -> DataFrame:
    """Joins split facts to the lines; the planner broadcasts them when their files are small.

    Beyond that the join shuffles on (file, split), where no key exceeds one split.
    """
    return lines.join(splits.select("_file", "_split", *columns), ["_file", "_split"], "left")


def place(before: str, id: str, first: str, size: str) -> Column:
    """Lines before its split plus a line's place in it; stops the job when the facts are not those of its split.

    The sum stands inside the test: a sum of nulls outside would let the planner make the join
    an inner one under a filter, and lines without facts would vanish.
    """
    at = F.col(id) - F.col(first)
    right = (at >= 0) & (at < F.col(size))
    return F.when(right, F.col(before) + at).otherwise(F.raise_error(F.lit(MOVED)).cast("bigint"))


def number_lines(lines: DataFrame, skip: int = 0, header: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(data lines with ``_line`` and dense ``_seq``, header line per file or None).

    ``_line`` counts physical lines from 0; ``_seq`` counts the non-blank data lines
    after the skipped lines and the header.
    """
    top = skip + (1 if header else 0)
    splits = split_table(lines, first_line=top == 1)
    columns = ["_first", "_lines", "_filled", "_offset", "_ffirst", "_filled_before"]
    headers, facts = None, splits
    if top:
        heads, filled_top = _heads(lines, splits, top)
        facts = splits.join(filled_top, "_file", "left")
        facts = facts.withColumn("_filled_before", F.col("_filled_before") - F.coalesce("_filled_top", F.lit(0)))
        if header:
            headers = heads.filter(F.col("_line") == skip).select("_file", F.col("_raw").alias("_header"))
            facts = facts.join(headers, "_file", "left")
            columns.append("_header")
        facts = stored(facts.select("_file", "_split", *columns), "facts")
    # ids of the filled lines are given after the blank ones are dropped, so they have no gaps
    data = lines.filter(~is_blank(F.col("_raw"))).withColumn("_fid", F.monotonically_increasing_id())
    data = attach(data, facts, *columns)
    kept = [
        "_file", "_raw",
        place("_offset", "_id", "_first", "_lines").alias("_line"),
        place("_filled_before", "_fid", "_ffirst", "_filled").alias("_seq"),
        "_split",
    ]
    if headers is not None:
        kept.append("_header")
    data = data.select(*kept)
    if top:
        data = data.filter(F.col("_line") >= top)
    return data, headers


def _heads(lines: DataFrame, splits: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """The first ``top`` lines of every file, and how many of them are not blank."""
    if top == 1:
        # the first line of the first split came with the split table: no further scan
        first = splits.groupBy("_file").agg(F.min_by("_line0", "_offset").alias("_raw"))
        heads = first.select("_file", F.lit(0).cast("bigint").alias("_line"), "_raw")
    else:
        # only splits that start inside the first lines can hold them
        early = splits.filter(F.col("_offset") < top).select("_file", "_split", "_first", "_lines", "_offset")
        line = place("_offset", "_id", "_first", "_lines")
        found = lines.join(early, ["_file", "_split"]).select("_file", line.alias("_line"), "_raw")
        heads = stored(found.filter(F.col("_line") < top), "heads")
    filled_top = heads.groupBy("_file").agg(F.count_if(~is_blank(F.col("_raw"))).alias("_filled_top"))
    return heads, filled_top

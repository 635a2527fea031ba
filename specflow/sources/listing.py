"""Which files to read: name filters, directories, file facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.session import stored
from specflow.sources.lines import pin_splits, text_lines


def normalise_filters(raw: list[str]) -> list[str]:
    """Comma lists become single trimmed patterns; blanks go."""
    return [part.strip() for entry in raw for part in entry.split(",") if part.strip()]


def normalise_filter_column(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda p: F.btrim(p)), lambda p: p != "")


def glob_of(filters: list[str]) -> str:
    """One path glob; a bare name matches as a prefix, no filter matches all."""
    names = [f if "*" in f or "?" in f else f + "*" for f in normalise_filters(filters)]
    if not names:
        return "*"
    return names[0] if len(names) == 1 else "{" + ",".join(names) + "}"


def glob_regex(pattern: str) -> str:
    out = "".join(".*" if ch == "*" else "." if ch == "?" else rf"\Q{ch}\E" for ch in pattern)
    return rf"\A{out}\z"


def matches(name: Column, filters: list[str]) -> Column:
    """The same choice as ``glob_of`` for a column of file names."""
    names = [f if "*" in f or "?" in f else f + "*" for f in normalise_filters(filters)]
    if not names:
        return F.lit(True)
    hit = F.lit(False)
    for n in names:
        hit = hit | name.rlike(glob_regex(n))
    return hit


def file_facts(spark: SparkSession, paths: str | list[str], glob: str | None = None, content: bool = True) -> DataFrame:
    """One row per file: path, name, size, modification time and, if asked, the digest of the bytes.

    Digests are made in parts, see ``digests``; no row holds a whole file.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # without the content column the files are listed, not read; files of no bytes are not listed by Spark
    files = reader.load(paths).select(
        F.col("_metadata.file_path").alias("remote_file_path"),
        plain(F.col("_metadata.file_name")).alias("remote_file_name"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("remote_last_modified"),
    )
    return files.join(digests(spark, paths, glob), "remote_file_path", "left") if content else files


#: bytes of a part, as object stores take them in multipart uploads
PART_BYTES = 10 << 20


def digests(spark: SparkSession, paths: str | list[str], glob: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """remote_file_path, n_parts and etag: the digest that an object store gives a file uploaded in parts.

    That is the MD5 of a file of one part, and of a longer one the MD5 of its parts' MD5s and their
    number. Files are read as lines of bytes, by splits; a line's place in its file is the running sum
    of the bytes before it, and what crosses the end of a part is cut there. So tasks hold a part at
    most (of a file without line breaks, a split's line).
    """
    pin_splits(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = text_lines(spark, paths, {"lineSep": "\n"}, glob).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.col("_metadata.file_size").alias("_size"),
        F.concat("value", F.lit("\n")).alias("_line"), F.monotonically_increasing_id().alias("_id"))
    sized = lines.withColumn("_bytes", F.octet_length("_line").cast("bigint"))
    # lines of a split have its order, and a split has a bounded number of them
    places = sized.select("_file", "_split", "_id", "_bytes", F.sum("_bytes").over(
        W.partitionBy("_file", "_split").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)).alias("_inside"))
    splits = sized.groupBy("_file", "_split").agg(F.sum("_bytes").alias("_all"))
    before = splits.select(
        "_file", "_split", F.sum("_all").over(W.partitionBy("_file")).alias("_read"),
        F.coalesce(F.sum("_all").over(W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = stored(places.join(before, ["_file", "_split"]).select(
        "_file", "_split", "_id", "_read", (F.col("_before") + F.coalesce("_inside", F.lit(0))).alias("_at")), "places")
    placed = sized.join(at, ["_file", "_split", "_id"])
    # the reader drops a mark of three bytes at the start of a file; the bytes that are missing tell
    marked = F.col("_size") - F.col("_read") >= 2
    first = marked & (F.col("_at") == 0)
    placed = placed.withColumns({
        "_line": F.when(first, F.concat(F.lit("\ufeff"), "_line")).otherwise(F.col("_line")),
        "_bytes": F.col("_bytes") + F.when(first, 3).otherwise(0),
        "_at": F.col("_at") + F.when(marked & ~first, 3).otherwise(0)})
    # the last line has no break if the bytes add up to one more than the file has
    length = F.least("_bytes", F.col("_size") - F.col("_at"))
    span = F.sequence(F.floor(F.col("_at") / part_bytes), F.floor((F.col("_at") + length - 1) / part_bytes))
    cut = placed.filter(length > 0).select("_file", "_at", length.alias("_length"), "_line", F.explode(span).alias("_part"))
    start = F.greatest(F.col("_part") * part_bytes - F.col("_at"), F.lit(0))
    stop = F.least((F.col("_part") + 1) * part_bytes - F.col("_at"), F.col("_length"))
    piece = F.substring(F.col("_line").cast("binary"), (start + 1).cast("int"), (stop - start).cast("int"))
    parts = cut.select("_file", "_part", F.struct("_at", F.hex(piece).alias("_hex")).alias("_piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["_hex"]), "")
    made = parts.groupBy("_file", "_part").agg(F.md5(F.unhex(joined)).alias("_md5"))
    of_file = made.groupBy("_file").agg(F.count(F.lit(1)).alias("n_parts"), F.array_sort(F.collect_list(F.struct("_part", "_md5"))).alias("_sums"))
    whole = F.md5(F.unhex(F.array_join(F.transform("_sums", lambda p: p["_md5"]), "")))
    etag = F.when(F.col("n_parts") == 1, F.get("_sums", F.lit(0))["_md5"]).otherwise(F.concat(whole, F.lit("-"), F.col("n_parts").cast("string")))
    return of_file.select(F.col("_file").alias("remote_file_path"), "n_parts", etag.alias("etag"))


def plain(name: Column) -> Column:
    """A name as it was given, from its spelling in a URI; a plus sign is one."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def stored_at(path: Column) -> Column:
    """Struct of bucket (the store's authority, empty for local files) and key of a path spelled as a URI."""
    return F.struct(
        F.regexp_extract(path, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/]*)/", 1).alias("bucket"),
        plain(F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?)?/*(.*)$", 1)).alias("key"),
    )


def archived_copies(spark: SparkSession, paths: str | list[str], glob: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The record of archived copies: name, bucket, key, size, etag, number of parts and modification time."""
    facts = file_facts(spark, paths, glob, content=False).join(digests(spark, paths, glob, part_bytes), "remote_file_path", "left")
    return facts.withColumn("_at", stored_at(F.col("remote_file_path"))).select(
        "remote_file_path", "remote_file_name", "_at.bucket", "_at.key", "file_size_bytes", "etag", "n_parts", "remote_last_modified")

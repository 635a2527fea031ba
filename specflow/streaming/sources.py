"""Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.commits import Files

# Files per poll and pause between polls.
FILES_PER_POLL = 20
POLL_PAUSE = "60 seconds"
#: polls that a backlog is dealt over, and files of a poll at most beside what is asked for, as their paths pass through the driver
BACKLOG_POLLS, MOST_FILES = 12, 5_000
# The columns of the two sources.
SCHEMAS = {"text": "value string", "binaryFile": "path string, modificationTime timestamp, length bigint, content binary"}


def poll_lines(spark: SparkSession, path: str, glob: str | None = None, files_per_poll: int = FILES_PER_POLL,
               after: str = "LEAVE", archive_dir: str | None = None) -> DataFrame:
    """Lines of files as they arrive. ``after`` is LEAVE, ARCHIVE (needs a folder) or DELETE.

    A poll takes ``files_per_poll`` files; of a backlog over ``BACKLOG_POLLS`` times as many, an even share.
    """
    return _polled(spark, "text", path, glob, files_per_poll, after, archive_dir).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.col("value").alias("_raw"),
    )


def poll_files(spark: SparkSession, path: str, glob: str | None = None, files_per_poll: int = FILES_PER_POLL,
               after: str = "LEAVE", archive_dir: str | None = None) -> DataFrame:
    """Files as they arrive, a row each with its ``_file``; what they hold is left to the reader of their format."""
    return _polled(spark, "binaryFile", path, glob, files_per_poll, after, archive_dir).select(
        F.col("_metadata.file_path").alias("_file"), F.col("length").alias("_bytes")
    )


def waiting_files(spark: SparkSession, path: str) -> int:
    """Files below a path, which may be a pattern; counted by the file system, none is listed here."""
    files = Files(spark, path)
    found = files.fs.globStatus(files.path(path)) or []
    return sum(files.fs.getContentSummary(f.getPath()).getFileCount() for f in found)


def poll_size(per_poll: int, waiting: int) -> int:
    """Files of a poll: every poll costs the same few jobs, so their number must not grow with the backlog."""
    return max(per_poll, min(-(-waiting // BACKLOG_POLLS), MOST_FILES))


def _polled(spark: SparkSession, kind: str, path: str, glob: str | None, files_per_poll: int, after: str, archive_dir: str | None) -> DataFrame:
    most = poll_size(files_per_poll, waiting_files(spark, path))
    reader = spark.readStream.format(kind).schema(SCHEMAS[kind]).option("maxFilesPerTrigger", str(most))
    reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if after == "ARCHIVE":
        if not archive_dir:
            raise ValueError("ARCHIVE needs an archive folder")
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    elif after == "DELETE":
        reader = reader.option("cleanSource", "delete")
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, schema, files_per_poll: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream; the last letter is put in a glob so single files work too."""
    reader = spark.readStream.schema(schema)
    if files_per_poll:
        reader = reader.option("maxFilesPerTrigger", str(files_per_poll))
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def topic_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", most: int | None = None) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", starting)
    if most:
        reader = reader.option("maxOffsetsPerTrigger", str(most))
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")

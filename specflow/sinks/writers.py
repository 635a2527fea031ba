"""Writers. All of them stream partitions; none brings rows to the driver."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.sinks import database

# Archive codec names as Spark spells them.
CODECS = {"NONE": "none", "GZIP": "gzip", "ZSTD": "zstd", "SNAPPY": "snappy"}


def to_kafka(df: DataFrame, options: dict) -> None:
    """Needs the Kafka connector on the class path; ``df`` has key and value."""
    if not options.get("topic"):
        raise ValueError("a topic name is required")
    df.select("key", "value").write.format("kafka").options(**options).save()


def to_files(df: DataFrame, options: dict) -> None:
    path = options["path"]
    writer = df.write.mode(options.get("mode", "errorifexists")).format(options.get("format", "parquet"))
    if options.get("partition_by"):
        writer = writer.partitionBy(*options["partition_by"])
    writer.options(**options.get("options", {})).save(path)


def to_database(df: DataFrame, options: dict) -> None:
    """Append, replace or upsert over JDBC in batches; UPSERT_ON_KEY stages the rows and merges them by ``key``."""
    kind = options.get("write_mode", "INSERT_ONLY")
    modes = {"INSERT_ONLY": "append", "REPLACE": "overwrite", "UPSERT_ON_KEY": None}
    if kind not in modes:
        raise ValueError(f"unknown write mode {kind}; known are {', '.join(modes)}")
    batch_size = options.get("batch_size", 1000)
    if kind == "UPSERT_ON_KEY":
        if not options.get("key"):
            raise ValueError("UPSERT_ON_KEY needs the key columns")
        database.merge(df, options["connection"], list(options["key"]), options.get("order"), batch_size)
        return
    writer = df.write.format("jdbc").mode(modes[kind]).option("batchsize", batch_size)
    if kind == "REPLACE":
        writer = writer.option("truncate", "true")
    writer.options(**options["connection"]).save()


def upserted(target: DataFrame, source: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Target rows without a source row, plus the (latest) source row per key."""
    source = database.newest(source, key, order)
    kept = target.join(source.select(*key), key, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def archive(df: DataFrame, path: str, fmt: str = "JSONL", compression: str = "GZIP", partition_by: list[str] | None = None) -> None:
    """Long-term copy. AVRO needs its module on the class path."""
    kind = {"JSONL": "json", "PARQUET": "parquet", "CSV": "csv", "AVRO": "avro"}[fmt]
    codec = CODECS[compression]
    if kind == "csv" and codec == "zstd":
        raise ValueError("csv archives take NONE, GZIP or SNAPPY")
    writer = df.write.mode("errorifexists").format(kind).option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_line_files(files: DataFrame, path: str, file: str = "file_name", line: str = "line", order: tuple[str, ...] = ("line_no",)) -> None:
    """Text files, one directory per file name, lines in order.

    A file is written by one task; cut large outputs into files of bounded size first
    (``generators.split_files``).
    """
    placed = files.repartition(file).sortWithinPartitions(file, *order).select(file, line)
    placed.write.partitionBy(file).text(path)


def fan_out(df: DataFrame, routes: dict[str, tuple[str | None, Callable[[DataFrame], None]]],
            strategy: str = "PARALLEL") -> dict[str, str]:
    """Writes one frame to several destinations from one evaluation.

    A route is (Spark SQL condition or None, writer). PARALLEL and BEST_EFFORT try all
    routes; SEQUENTIAL stops at the first failure. Returns the outcome per route.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)

    def run(name: str) -> str:
        condition, writer = routes[name]
        try:
            writer(held if condition is None else held.filter(condition))
            return "SUCCESS"
        except Exception as problem:  # the outcome table carries the reason
            return f"FAILED: {type(problem).__name__}"

    try:
        if strategy == "PARALLEL":
            with ThreadPoolExecutor(max_workers=min(8, len(routes))) as pool:
                return dict(zip(routes, pool.map(run, routes)))
        results: dict[str, str] = {}
        for name in routes:
            stopped = strategy == "SEQUENTIAL" and any(v.startswith("FAILED") for v in results.values())
            results[name] = "SKIPPED" if stopped else run(name)
        return results
    finally:
        held.unpersist()


def expired(archives: DataFrame, archived_on: str, today, days: int) -> DataFrame:
    """Archive rows past their retention."""
    return archives.filter(F.datediff(today, F.col(archived_on)) > days)

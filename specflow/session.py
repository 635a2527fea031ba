"""Session defaults, table access and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "specflow", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # rule-heavy projections make methods the JVM will not compile; past this size Spark splits them
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # no call-site capture per expression: halves the time to build large plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPECFLOW_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local session without that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so reruns cannot mix."""
    return f"{shared_dir(spark)}/specflow/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: fixed rows whose size the planner knows."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows of a stored table that may be broadcast
BROADCAST_ROWS = 100_000


def joinable(df: DataFrame) -> DataFrame:
    """A stored table as the smaller side of a join.

    The planner knows the size of its files, and repeated paths compress a hundredfold; so beyond a
    number of rows the join shuffles, or the driver would gather them all.
    """
    return df if df.count() <= BROADCAST_ROWS else df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes nondeterministic columns."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)

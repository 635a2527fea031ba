"""Results per window that can be replaced one window at a time.

Rows are written once, below the version and the window they belong to. A version is a manifest
that names for each window the version whose rows it has; replacing a window writes its new
rows and a manifest that differs in this window only, so all other rows stay the very same files.
A reader holds one version: the manifest is joined to the folders, which prunes all others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.commits import CommitLog

TRIES = 20


def _folder(window: Column) -> Column:
    """Name of a window's folders; it starts with a letter, so nothing takes it for a number or a day."""
    return F.coalesce(F.concat(F.lit("w"), window.cast("string")), F.lit("null"))


class WindowStore:
    """``key`` is the column that names a row's window; it must be text, a number or a date."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key, self.log = spark, folder, key, CommitLog(spark, folder)

    def version(self) -> int:
        return self.log.newest()

    def _write(self, rows: DataFrame) -> str:
        run = f"r{uuid.uuid4().hex}"
        rows.withColumn("_window", _folder(F.col(self.key))).write.partitionBy("_window").parquet(f"{self.folder}/rows/run={run}")
        return run

    def _manifest(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/manifests/{name}")
        return name

    def manifest(self, version: int | None = None) -> DataFrame:
        """_window and the run that wrote its rows, as of a version."""
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], "_window string, run string")
        return self.spark.read.parquet(f"{self.folder}/manifests/{self.log.entry(version)['manifest']}")

    def publish(self, rows: DataFrame) -> int:
        """A version of these rows alone."""
        run = self._write(rows)
        named = self._runs().filter(F.col("run") == run).select("_window").distinct()
        return self._commit(lambda _: named.select("_window", F.lit(run).alias("run")))

    def replace(self, window, rows: DataFrame) -> int:
        """A version in which one window has these rows, none at all if there are none; rows of other windows fail the run."""
        name = _folder(F.lit(window))
        # checked before anything is written: no run may touch another window by mistake
        if not rows.filter(_folder(F.col(self.key)) != name).isEmpty():
            raise ValueError(f"rows for window {window} belong to other windows")
        run = None if rows.isEmpty() else self._write(rows)
        one = self.spark.range(1 if run else 0).select(name.alias("_window"), F.lit(run or "").alias("run"))
        return self._commit(lambda before: before.filter(F.col("_window") != name).unionByName(one))

    def _commit(self, change) -> int:
        for _ in range(TRIES):
            before = self.version()
            manifest = self._manifest(change(self.manifest(before)))
            if self.log.commit(before + 1, {"manifest": manifest}):
                return before + 1
        raise RuntimeError(f"{TRIES} other writers came first")

    def _runs(self) -> DataFrame:
        schema = "run string, _window string"
        return self.spark.read.option("basePath", f"{self.folder}/rows").schema(schema).parquet(f"{self.folder}/rows/run=*")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of one version, the newest unless another is named."""
        version = self.version() if version is None else version
        manifest = self.manifest(version)
        if version < 0 or manifest.isEmpty():
            raise ValueError(f"version {version} of {self.folder} has no windows")
        data = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows/run=*")
        return data.join(manifest, ["run", "_window"], "left_semi").drop("run", "_window")

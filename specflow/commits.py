"""Folders that change by commits: a numbered log of small entries, each made by one writer only.

What a commit adds is written first, under a name nobody else uses. The commit itself is the
creation of one small file, which the file system refuses when the number is taken. So a
run that fails changes nothing, readers see one state or the next, and of two writers that start
from the same state the second one learns it and looks again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """The file system calls of the driver on a few paths: Hadoop's, so any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False when there is one of that name."""
        hadoop = self.jvm.org.apache.hadoop.fs
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            # a rename that does not replace: of two drafts one gets the name, and a name stands for a whole file
            context = hadoop.FileContext.getFileContext(self.path(name).toUri(), self.conf)
            option = getattr(hadoop, "Options$Rename")
            none = self.jvm.java.lang.reflect.Array.newInstance(option.NONE.getClass(), 0)
            context.rename(self.path(draft), self.path(name), none)
            return True
        except Exception as problem:
            if self.fs.exists(self.path(name)):
                self.fs.delete(self.path(draft), False)
                return False
            raise problem

    def move(self, name: str, to: str) -> None:
        target = self.path(to)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self.path(name), target):
            raise OSError(f"{name} could not be moved to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), False)


class CommitLog:
    """Entries 0, 1, 2 … of a folder, each a small JSON object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = f"{folder}/_commits"
        self.files = Files(spark, folder)

    def newest(self) -> int:
        """Number of the last entry, -1 without one."""
        return max((int(n) for n in self.files.names(self.folder) if n.isdigit()), default=-1)

    def entry(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{number:012d}"))

    def commit(self, number: int, entry: dict) -> bool:
        """Adds entry ``number``; False when another writer has done so."""
        return self.files.create(f"{self.folder}/{number:012d}", json.dumps(entry))

"""Versions of a stored table: what its files are, as one small file for each version.

A writer puts new files beside the old ones and then creates the next version's file. That fails if another writer created it first, so
nobody's change is lost; readers see whole versions only. Files that no kept version names can be deleted.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first: read again and repeat the change."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and the same for all that read it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/{name}" if name else f"{self.path}/_versions")

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        return max(self.numbers(), default=0)

    def content(self, number: int) -> dict:
        """What version ``number`` says; version 0 is empty."""
        if not number:
            return {}
        stream = self._fs.open(self._path(str(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, content: dict) -> int:
        """Makes ``content`` version ``number``, which must not exist."""
        # The whole file is there before its name is: a reader never sees a part.
        draft = self._path(f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        try:
            if self._fs.exists(self._path(str(number))) or not self._fs.createNewFile(self._path(f".{number}.taken")):
                raise Conflict(f"{self.path}: version {number} is another writer's")
            if not self._fs.rename(draft, self._path(str(number))):
                raise Conflict(f"{self.path}: version {number} could not be made")
        finally:
            self._fs.delete(draft, False)
        return number

    def expire(self, keep: int, folders) -> list[str]:
        """Forgets all but the last ``keep`` versions, and deletes folders (``folders(content)``, within the table) that only these named. Returns them."""
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        needed = {f for n in kept for f in folders(self.content(n))}
        gone = sorted({f for n in old for f in folders(self.content(n))} - needed)
        for number in old:
            self._fs.delete(self._path(str(number)), False)
        for folder in gone:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"), True)
        return gone

    def bytes_of(self, folder: str) -> int:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

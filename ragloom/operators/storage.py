"""The stored corpus: buckets of files' chunks, in versions.

Chunks lie in buckets by a hash of their file's path, with the metadata that queries filter on as columns of their own. A change writes the buckets that it
touches and then a manifest, which names the folders of all buckets; the others stay as they are. A writer that comes second gets a
:class:`Conflict`, and nothing of it is seen. Old versions stay readable until they expire.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import HOISTED, SCHEMA, hoisted, upsert
from .versions import Conflict, Versions, stable

__all__ = ["BUCKETS", "Conflict", "CorpusTable"]

BUCKETS = 64
STORED = SCHEMA + ", " + ", ".join(f"{k} string" for k in HOISTED)


class CorpusTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self._buckets = buckets
        self.bytes_written = 0  # by this writer's last change

    def version(self) -> int:
        return self.versions.latest()

    def _content(self, version: int | None = None) -> dict:
        found = self.versions.content(self.versions.latest() if version is None else version)
        return found or {"buckets": self._buckets, "folders": {}, "top": 0, "batches": {}}

    def read(self, version: int | None = None) -> DataFrame:
        """The chunks of a version, the latest by default; filters on the columns :data:`HOISTED` reach the files."""
        folders = self._content(version)["folders"]
        return self._of(list(folders.values()))

    def _of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], STORED)

    def replace_files(self, chunks: DataFrame, files: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """A version in which the chunks of ``files`` (relative_path, source) are ``chunks`` (id, document, metadata, embedding, position).

        All chunks go that have the path, or the source, of one of ``files``; a null path or source removes nothing. Chunks of the same ids are replaced where they are. Returns
        the version. ``batch`` names a stream and its batch: one that is done already changes nothing.
        """
        number = self.versions.latest()
        content = self._content(number)
        if batch and content["batches"].get(batch[0], -1) >= batch[1]:
            return number
        own = stable(chunks.select("id", "document", "metadata", "embedding", "position"), "new-chunks")
        gone = stable(files.select("relative_path", "source").distinct(), "files")
        n = content["buckets"]
        hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        place = F.when(F.col("relative_path").isNotNull(), hashed("relative_path")).otherwise(hashed("id"))
        whole = self.read(number)
        # buckets of the files, of other files that share a source, and of chunks whose ids come again: at most as many as there are
        by_source = whole.select("source", place.alias("b")).join(gone.select("source").distinct(), "source", "left_semi").select("b")
        by_id = whole.select("id", place.alias("b")).join(own.select("id").distinct(), "id", "left_semi").select("b")
        new = hoisted(own).select(place.alias("b"))
        touched = sorted(r[0] for r in gone.filter("relative_path is not null").select(hashed("relative_path").alias("b")).unionAll(by_source).unionAll(by_id).unionAll(new).distinct().collect())
        current = self._of([content["folders"][str(b)] for b in touched if str(b) in content["folders"]])
        kept = current.join(gone.select("relative_path").distinct(), "relative_path", "left_anti").join(gone.select("source").distinct(), "source", "left_anti")
        changed = upsert(kept.select(*(f.split()[0] for f in SCHEMA.split(", "))), own, top=content["top"])
        folder = f"data/{uuid.uuid4().hex}"
        rows = hoisted(changed).withColumn("bucket", place)
        # ranges split a file with very many chunks
        rows.repartitionByRange("bucket", "relative_path", "row_seq").sortWithinPartitions("bucket", "relative_path", "row_seq").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = self.spark.read.schema(STORED + ", bucket int").parquet(f"{self.path}/{folder}").groupBy("bucket").agg(F.max("row_seq").alias("top")).collect()  # a row for each bucket
        folders = {b: f for b, f in content["folders"].items() if int(b) not in touched} | {str(r.bucket): f"{folder}/bucket={r.bucket}" for r in made}
        top = max([content["top"], *(r.top for r in made)])
        batches = content["batches"] | ({batch[0]: batch[1]} if batch else {})
        self.versions.commit(number + 1, {"buckets": n, "folders": folders, "top": top, "batches": batches})
        self.bytes_written = self.versions.bytes_of(folder)
        return number + 1

    def upsert(self, rows: DataFrame) -> int:
        """A version with ``rows`` inserted or replaced by id."""
        return self.replace_files(rows, self.spark.createDataFrame([], "relative_path string, source string"))

    def delete(self, relative_path: str | None = None, source: str | None = None) -> int:
        """A version without the chunks of a path or of a source."""
        none = self.spark.createDataFrame([], "id string, document string, metadata string, embedding array<float>, position long")
        return self.replace_files(none, self.spark.createDataFrame([(relative_path, source)], "relative_path string, source string"))

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes what only versions before the last ``keep`` hold."""
        return self.versions.expire(keep, lambda content: list(content["folders"].values()))

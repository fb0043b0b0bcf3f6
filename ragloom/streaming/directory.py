"""A folder as a stream: files that are new or have changed since the last look.

An offset is a snapshot of the folder's listing. What differs between two snapshots is a batch, so a file that is rewritten at its path comes
again, and after a restart the batch that was not finished is made of the same two snapshots. Deleted files and folders within are passed over.
"""

from __future__ import annotations

import datetime
import json
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, length long, content binary"
#: Bytes of files that a task reads.
TASK_BYTES = 64 << 20


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.snapshots = options["path"].rstrip("/"), options["snapshots"].rstrip("/")
        self.settle = float(options.get("settleSeconds", "0"))
        self.task_bytes = int(options.get("taskBytes", str(TASK_BYTES)))

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def _snapshot(self, number: int) -> dict[str, list[int]]:
        if not number:
            return {}
        files, root = _filesystem(self.snapshots)
        with files.open_input_stream(posixpath.join(root, f"{number}.json")) as f:
            return json.loads(f.read().decode())

    def _last(self) -> int:
        from pyarrow import fs

        files, root = _filesystem(self.snapshots)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return max((int(i.base_name[:-5]) for i in found if i.base_name.endswith(".json") and i.base_name[:-5].isdigit()), default=0)

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files, root = _filesystem(self.folder)
        number = self._last()
        before = self._snapshot(number)
        newest = datetime.datetime.now(datetime.timezone.utc).timestamp() - self.settle
        now = dict(before)
        for info in files.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.File and info.mtime is not None and info.mtime.timestamp() <= newest:  # one that is still being written waits
                now[info.path] = [int(info.mtime_ns), info.size]
        if now == before:
            return {"snapshot": number}
        kept, root = _filesystem(self.snapshots)
        kept.create_dir(root, recursive=True)
        draft = posixpath.join(root, f".{number + 1}")
        with kept.open_output_stream(draft) as f:
            f.write(json.dumps(now).encode())
        kept.move(draft, posixpath.join(root, f"{number + 1}.json"))
        return {"snapshot": number + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"])
        changed = sorted((path, *at) for path, at in new.items() if old.get(path) != at)
        parts, size = [[]], 0
        for file in changed:
            if parts[-1] and size + file[2] > self.task_bytes:
                parts.append([])
                size = 0
            parts[-1].append(file)
            size += file[2]
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, _ = _filesystem(self.folder)
        for path, mtime, size in partition.files:
            try:
                with files.open_input_stream(path) as f:
                    content = f.read()
            except FileNotFoundError:
                continue  # gone since
            yield path, datetime.datetime.fromtimestamp(mtime / 1e9, datetime.timezone.utc), size, content

    def commit(self, end: dict) -> None:
        """Snapshots before the one that is done are of no more use."""
        files, root = _filesystem(self.snapshots)
        for number in range(max(1, end["snapshot"] - 10), end["snapshot"]):
            at = posixpath.join(root, f"{number}.json")
            if files.get_file_info(at).is_file:
                files.delete_file(at)


class DirectoryChanges(DataSource):
    """Format ``directory_changes``: options path, snapshots (a folder of its own), settleSeconds (files changed later than that wait) and taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def read_changes(spark: SparkSession, folder: str, snapshots: str, settle: float = 0.0) -> DataFrame:
    """The stream of new and changed files of ``folder``: ``path, modified, length, content``. ``snapshots`` keeps the listings; each stream has its own."""
    spark.dataSource.register(DirectoryChanges)
    return spark.readStream.format("directory_changes").option("snapshots", snapshots).option("settleSeconds", str(settle)).load(folder)

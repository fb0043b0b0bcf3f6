"""Token ids in Parquet files that allow selective reads of ids and of metadata.

A row holds one document: ``doc_id, shard_start, n_tokens, ids``. Rows are in ascending
document order over the shards and within them. ``ids`` is a list column with dictionary encoding; the
other columns are delta encoded. Row groups hold about :data:`GROUP_IDS` ids, pages at most
:data:`PAGE_BYTES` bytes or :data:`PAGE_ROWS` documents, and page indexes are written: Spark's reader then skips row groups by their statistics and, within one, the
pages of all columns that hold no document of the range. A query of the metadata never touches the ids. A manifest names the file of each shard with its numbers of rows and ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_units import encoder, groups
from .common import filesystem, tidied, written

GROUP_IDS, PAGE_BYTES, PAGE_ROWS = 8 << 20, 256 << 10, 256
MANIFEST = "shard int, file string, n_rows long, n_tokens long"


def _writer(file, schema: pa.Schema):
    import pyarrow.parquet as pq

    delta = {c: "DELTA_BINARY_PACKED" for c in schema.names if pa.types.is_integer(schema.field(c).type)}
    return pq.ParquetWriter(file, schema, compression="zstd", compression_level=1, version="2.6", data_page_version="2.0", use_dictionary=["ids.list.element"], column_encoding=delta, write_page_index=True, data_page_size=PAGE_BYTES, max_rows_per_page=PAGE_ROWS)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of each text, then ``end_id``, to files in ``path``; returns the manifest, a table.

    A null text is empty and so has the end id alone. Rows with equal ids stand next to
    each other, ordered by text; null ids come first. Other columns are
    ignored. An empty table gives an empty manifest. A task that is run again writes another file; the
    manifest names the one that counts. ``before`` in the manifest is the number of ids in the shards before.
    """
    vocabulary_path = public_tokenizers.path(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, start, rows, tokens = context.partitionId() if context else 0, 0, 0, encoder(vocabulary_path)
        writer = file = None
        held: list[pa.RecordBatch] = []
        name = f"part-{shard:06d}-{uuid.uuid4().hex}.parquet"

        def flush() -> None:
            nonlocal writer, file
            if writer is None:
                system, inner = filesystem(path)
                system.create_dir(inner, recursive=True)
                file = system.open_output_stream(f"{inner}/{name}")
                writer = _writer(file, held[0].schema)
            writer.write_table(pa.Table.from_batches(held), row_group_size=1 << 30)
            held.clear()

        for batch in batches:
            for i, j in groups(batch.column(1)):
                ids, ends = tokens.encode_column(batch.column(1).slice(i, j - i), end_id)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                held.append(pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), lists], ["doc_id", "shard_start", "n_tokens", "ids"]))
                start, rows = start + len(ids), rows + j - i
                if sum(len(h.column(3).values) for h in held) >= GROUP_IDS:
                    flush()
        if held:
            flush()
        if writer is not None:
            writer.close()
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([rows], pa.int64()), pa.array([start], pa.int64())], ["shard", "file", "n_rows", "n_tokens"])

    ordered = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(tidied(each, own="encoders"), MANIFEST), "token-manifest")
    # one row for each shard, so the window without partitions is over few rows
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("before", F.coalesce(before, F.lit(0)))


def _tables(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of the files that manifest rows name, with the ids before the file; only ``columns`` are read."""
    import pyarrow.parquet as pq

    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, inner = filesystem(path)
            with system.open_input_file(inner) as source, pq.ParquetFile(source) as file:
                for part in file.iter_batches(batch_size=8192, columns=columns):
                    yield before, part


def _over_files(manifest: DataFrame, function, schema: str) -> DataFrame:
    files = max(1, manifest.count())
    return manifest.select("file", "before").repartition(files, "file").mapInArrow(tidied(function), schema)


def read_tokens(manifest: DataFrame, kind: str = "long", with_ids: bool = True, low: int | None = None, high: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens[, ids]`` of the files of ``manifest``; documents from ``low`` to ``high`` if these are given.

    ``start`` is the number of ids of all documents before. The names of the files, one for each shard, come to the driver; their
    rows are read by Spark, by pages where a range is given.
    """
    spark = manifest.sparkSession
    files = [r.file for r in manifest.select("file").collect()]
    stored = f"doc_id {kind}, shard_start long, n_tokens long, ids array<int>"
    if not files:
        return spark.createDataFrame([], stored).select("doc_id", F.col("shard_start").alias("start"), "n_tokens", *["ids"] * with_ids)
    rows = spark.read.schema(stored).parquet(*files)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    before = manifest.select(F.substring_index("file", "/", -1).alias("name"), "before")
    named = rows.select("doc_id", "shard_start", "n_tokens", *["ids"] * with_ids, F.col("_metadata.file_name").alias("name")).join(before, "name")
    return named.select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", *["ids"] * with_ids)


def digests(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the files, from the ids that are read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, part in _tables(batches, ["doc_id", "shard_start", "ids.list.element"]):
            ids = part.column(2)
            at, data = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            raw = memoryview(np.ascontiguousarray(data, "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(part.column(1).to_numpy() + before), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _over_files(manifest, each, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")

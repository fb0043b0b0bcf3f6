"""Packing of documents into sequences by bounded-space online best-fit.

A packer keeps a fixed number of open bins. A bitset has a bit for each amount of free
space that some open bin has, so the bin that a piece fits best is the lowest set
bit at or above the piece's length. When no open bin fits and all places are taken, the fullest
bin (the lowest set bit) closes and a new one opens. A bin that closes is written as a sequence of ids with the pieces in it;
where pieces stand is read back from the sequences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_units import encoder, groups
from .common import forget, tidied, written

CAPACITY = 1024
#: Open bins of a packer: at most so many times the capacity of ids are held.
OPEN_BINS = 4096
#: Pieces that one packer takes; more pieces get more packers.
PIECES_PER_PACKER = 50_000
#: Closed bins that are handed on together.
BINS_TOGETHER = 1024


class Packer:
    """Places lengths one by one; ``place`` returns (bin, offset). Bins that take no more are in ``closed``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.open, self.bins = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.closed: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} ids does not fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self.by_free[free].pop()
            if not self.by_free[free]:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            if self.open >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.closed.append(self.by_free[fullest].pop())
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
            free, number = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(number)
        return number, self.capacity - free


def id_bytes(vocabulary: str) -> int:
    """Bytes of an id while pieces are moved: two where the vocabulary's numbers fit, else four."""
    return 2 if encoder(public_tokenizers.path(vocabulary)).library.get_vocab_size() <= 1 << 16 else 4


def _bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all values of a binary column, one after another, and where each begins and the last one ends."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    return memoryview(column.buffers()[2] or b"")[at[0] : at[-1]].tobytes(), at - at[0]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, ids`` of documents cut to at most ``capacity`` ids; ``ids`` are little-endian integers of :func:`id_bytes` in one binary value.

    Only documents that are longer are cut; their first piece takes what full pieces leave. A null
    text is empty, so its one piece is the end id. Other columns are ignored; repeated rows stay.
    """
    path, width = public_tokenizers.path(vocabulary), id_bytes(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for i, j in groups(batch.column(1)):
                ids, ends = tokens.encode_column(batch.column(1).slice(i, j - i), end_id)
                n = np.diff(ends)
                count = -(-n // capacity)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece > 0, n[row] - (count[row] - piece) * capacity, 0)  # the first piece takes what full pieces leave
                cuts = (width * np.append(ends[row] + start, ends[-1])).astype(np.int64)
                packed = pa.py_buffer(np.ascontiguousarray(ids, "<u2" if width == 2 else "<i4"))
                cut = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts), packed]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), cut], ["doc_id", "piece", "start", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(tidied(each, own="encoders"), f"doc_id {kind}, piece int, start long, ids binary")


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, width: int = 4) -> DataFrame:
    """``sequence_id, ids, parts`` of the pieces ``doc_id, piece, start, ids``: each sequence's ids, of ``width`` bytes, and the pieces in it, in order.

    ``items`` is read twice, so it should be a table. Pieces are dealt by a hash of document and number to packers
    of about :data:`PIECES_PER_PACKER` each; a packer's last open bins are its only loss against one
    packer for all. Ties are placed in the order of the hash.
    """
    packers = max(1, math.ceil(items.count() / PIECES_PER_PACKER))
    kind = items.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, packer = TaskContext.get(), Packer(capacity, open_bins)
        base = (context.partitionId() if context else 0) << 40
        held: dict[int, list[tuple]] = {}

        def out(bins: list[int], id_type: pa.DataType) -> pa.RecordBatch:
            rows = [held.pop(b) for b in bins]
            offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            doc, piece, start, ids = zip(*(r for of in rows for r in of))
            length = pa.array([len(x) // width for x in ids], pa.int32())
            parts = pa.StructArray.from_arrays([pa.array(doc, id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), length], ["doc_id", "piece", "start", "length"])
            joined = [b"".join(r[3] for r in of) for of in rows]
            return pa.RecordBatch.from_arrays([pa.array([base + b for b in bins], pa.int64()), pa.array(joined, pa.binary()), pa.ListArray.from_arrays(offsets, parts)], ["sequence_id", "ids", "parts"])

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field(0).type
            data, at = _bytes(batch.column(3))
            ids = [data[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
            for r in zip(batch.column(0).to_pylist(), *(c.to_numpy().tolist() for c in batch.columns[1:3]), ids, strict=True):
                held.setdefault(packer.place(len(r[3]) // width)[0], []).append(r)
                if len(packer.closed) >= BINS_TOGETHER:
                    yield out(packer.closed, id_type)
                    packer.closed = []
        rest = list(held)
        for i in range(0, len(rest), BINS_TOGETHER):
            yield out(rest[i : i + BINS_TOGETHER], id_type)

    columns = ["doc_id", "piece", "start", "ids"]
    dealt = items.select(*columns, F.xxhash64("doc_id", "piece").alias("_order")).repartition(packers, "_order").sortWithinPartitions("_order", "doc_id", "piece")
    return dealt.mapInArrow(tidied(each), f"sequence_id long, ids binary, parts array<struct<doc_id:{kind},piece:int,start:long,length:int>>")


def places(sequences: DataFrame, with_ids: bool = False, width: int = 4) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset`` of the pieces in ``sequences``, from the ids that stand there."""
    kind = sequences.schema["parts"].dataType.elementType["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2)
            ends = parts.offsets.to_numpy()
            doc, piece, start, length = parts.flatten().flatten()
            n = length.to_numpy().astype(np.int64)
            sequence = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            before = np.concatenate([[0], np.cumsum(n)])
            offset = before[:-1] - np.repeat(before[ends[:-1] - ends[0]], np.diff(ends))
            raw, at = _bytes(batch.column(1))
            if (at != width * before[ends - ends[0]]).any():
                raise ValueError("a sequence's ids are not as many as its pieces have")
            ids = np.frombuffer(raw, "<u2" if width == 2 else "<i4").astype("<i4")  # of all pieces, as they follow each other
            data = memoryview(ids).cast("B")
            cuts = (4 * before).tolist()
            columns = [doc, piece, start, pa.array(n), pa.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return sequences.mapInArrow(tidied(each), schema)


def pack_sequences(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences of ``docs``, a table in the shared folder, as :func:`pack` gives them.

    Rows with a null id, repeated rows and empty texts are packed as any others. An empty table gives an empty result.
    """
    cut = written(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    sequences = written(pack(cut, capacity, open_bins, id_bytes(vocabulary)), "sequences")
    forget(cut)
    return sequences


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their place in the sequences of :func:`pack_sequences`, read back from these; see :func:`places`."""
    return places(pack_sequences(docs, vocabulary, end_id, capacity, open_bins, id_col, text_col), with_ids, id_bytes(vocabulary))

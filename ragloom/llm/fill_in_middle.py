"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames with the counts of bytes, code points and ended lines before each. Cuts are lines: the
counts tell the frame in which a cut lies, and that frame alone is decompressed to find it. Prefix, middle and suffix are then
streamed frame by frame in the order of the form into frames of the result, and digests are taken from frames in order. Nothing but the
text that Spark hands over is ever whole in memory.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidied, written

#: Bytes of text in a frame.
FRAME_BYTES = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The markers in the order of the form, and the places of prefix, middle and suffix in it.
FORMS = {"psm": ((PREFIX, SUFFIX, MIDDLE), (0, 2, 1)), "spm": ((SUFFIX, PREFIX, MIDDLE), (1, 2, 0))}
FRAMES = "struct<data: array<binary>, bytes: array<long>, chars: array<long>, lines: array<long>>"


def pieces(parts: Iterable[bytes], size: int) -> Iterator[bytes]:
    """The same bytes in pieces of ``size`` at most, cut between code points."""
    rest = b""
    for part in parts:
        data, at = rest + part if rest else part, 0
        while len(data) - at > size:
            cut = at + size
            while cut > at and data[cut] & 0xC0 == 0x80:
                cut -= 1
            cut = cut if cut > at else at + size
            yield data[at:cut]
            at = cut
        rest = data[at:]
    if rest:
        yield rest


def n_chars(data: bytes) -> int:
    """Code points that begin in UTF-8 bytes; they may be cut anywhere."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


class Frames:
    """Compressed frames with cumulative counts; the frame that was read last stays decompressed."""

    def __init__(self, data: list[bytes], bytes_: list[int], chars: list[int], lines: list[int]):
        self.data, self.bytes, self.chars, self.lines = data, bytes_, chars, lines
        self._last: tuple[int, bytes] = (-1, b"")

    @classmethod
    def of(cls, parts: Iterable[bytes], size: int = FRAME_BYTES) -> Frames:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        data, bytes_, chars, lines = [], [0], [0], [0]
        for piece in pieces(parts, size):
            data.append(compressor.compress(piece))
            bytes_.append(bytes_[-1] + len(piece))
            chars.append(chars[-1] + n_chars(piece))
            lines.append(lines[-1] + piece.count(b"\n"))
        return cls(data, bytes_, chars, lines)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self._last = (k, zstandard.ZstdDecompressor().decompress(self.data[k]))
        return self._last[1]

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """Bytes ``start`` to ``end``, frame by frame."""
        end = self.bytes[-1] if end is None else end
        k = max(0, bisect_right(self.bytes, start) - 1)
        while k < len(self.data) and self.bytes[k] < end:
            yield self.frame(k)[max(0, start - self.bytes[k]) : end - self.bytes[k]]
            k += 1

    def n_lines(self) -> int:
        """Lines with their ends, and what stands after the last end."""
        return self.lines[-1] + bool(self.data and not self.frame(len(self.data) - 1).endswith(b"\n"))

    def after_lines(self, n: int) -> tuple[int, int]:
        """Where the first ``n`` lines end: in bytes and in code points."""
        if n == 0 or n > self.lines[-1]:
            return (0, 0) if n == 0 else (self.bytes[-1], self.chars[-1])
        k = bisect_left(self.lines, n) - 1
        frame, at = self.frame(k), -1
        for _ in range(n - self.lines[k]):
            at = frame.find(b"\n", at + 1)
        return self.bytes[k] + at + 1, self.chars[k] + n_chars(frame[: at + 1])

    def find(self, marker: bytes, start: int = 0) -> int:
        """The first place of ``marker`` from ``start`` on, also across frames; -1 if there is none."""
        at, tail = start, b""
        for part in self.stream(start):
            joined = tail + part
            found = joined.find(marker)
            if found >= 0:
                return at - len(tail) + found
            at += len(part)
            tail = joined[-(len(marker) - 1) :] if len(marker) > 1 else b""
        return -1

    def digest(self, *ranges: tuple[int, int]) -> str:
        """SHA-256 of all bytes, or of ranges one after the other, in lower-case hex."""
        h = hashlib.sha256()
        for start, end in ranges or ((0, self.bytes[-1]),):
            for part in self.stream(start, end):
                h.update(part)
        return h.hexdigest()

    def row(self) -> dict:
        return {"data": self.data, "bytes": self.bytes, "chars": self.chars, "lines": self.lines}


def chances(doc_id, seed: int) -> tuple[int, int, int, int]:
    """The four numbers that decide a document's cuts and form."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))


def transformed(text: Frames, doc_id, seed: int, rate: int, spm_rate: int, marked: bool, size: int = FRAME_BYTES) -> tuple[Frames, str, int, int | None, int | None]:
    """Frames of the result, its form, the number of lines, and the code points of prefix and middle (none if plain)."""
    h1, h2, h3, h4 = chances(doc_id, seed)
    n = text.n_lines()
    if not n or marked or h3 % 100 >= rate:
        return text, "plain", n, None, None
    (a, a_chars), (b, b_chars) = map(text.after_lines, sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    place = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, text.bytes[-1])}

    def parts() -> Iterator[bytes]:
        for marker in FORMS[form][0]:
            yield marker
            yield from text.stream(*place[marker])

    return Frames.of(parts(), size), form, n, a_chars, b_chars - a_chars


def ranges(output: Frames, form: str) -> list[tuple[int, int]]:
    """Where prefix, middle and suffix stand in a result, by its markers."""
    if form == "plain":
        return [(0, output.bytes[-1])]
    markers, order = FORMS[form]
    starts, at = [], 0
    for marker in markers:
        at = output.find(marker, at)
        starts.append(at)
        at += len(marker)
    ends = [*starts[1:], output.bytes[-1]]
    return [(starts[k] + len(markers[k]), ends[k]) for k in order]


def _batches(function: Callable[[dict], dict], schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [function(row) for row in batch.drop_columns(["row"]).to_pylist()]
            columns = [batch.column(0), *(pa.array([r[f.name] for r in own], f.type) for f in list(kinds)[1:])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kinds])

    return tidied(each)


def _schema(row: T.StructField, fields: str) -> T.StructType:
    return T.StructType([row, *T._parse_datatype_string(fields)])


def store(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``row, id, marked, text``: each row of ``docs`` with its text as frames, and whether the text holds one of the markers.

    ``row`` is a struct of the columns ``keep`` (all but the text by default), so names never clash. A null text is empty and has no frames. Rows that
    are repeated stay so; an empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col]
    present = "_present"
    while present in keep:
        present += "_"
    row = F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(True).alias(present)).alias("row")
    source = docs.select(row, F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("raw"))
    schema = _schema(source.schema["row"], f"id string, marked boolean, text {FRAMES}")

    def each(r: dict) -> dict:
        raw = r["raw"] or b""
        return {"id": r["id"], "marked": any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)), "text": Frames.of([raw], frame_bytes).row()}

    return source.mapInArrow(_batches(each, schema), schema)


def _frames(row: dict) -> Frames:
    return Frames(row["data"], row["bytes"], row["chars"], row["lines"])


def transform(stored: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``row, n, form, prefix_chars, middle_chars, output`` from rows of :func:`store`; ``output`` is frames of the result.

    ``n`` counts lines. Of a hundred documents ``rate`` are cut at two lines chosen by a hash of seed and id, and of these ``spm_rate`` have the suffix
    first. Empty texts and those with a marker are plain: they stay as they are, and the numbers of code points are null. A null id is hashed as the empty text.
    """
    schema = _schema(stored.schema["row"], f"n long, form string, prefix_chars long, middle_chars long, output {FRAMES}")

    def each(r: dict) -> dict:
        output, form, n, prefix, middle = transformed(_frames(r["text"]), r["id"], seed, rate, spm_rate, r["marked"], frame_bytes)
        return {"n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output.row()}

    return stored.mapInArrow(_batches(each, schema), schema)


def restored_texts(made: DataFrame) -> DataFrame:
    """``row, text``: the exact texts, from results and their forms alone."""
    schema = _schema(made.schema["row"], "text string")

    def each(r: dict) -> dict:
        output = _frames(r["output"])
        return {"text": b"".join(p for start, end in ranges(output, r["form"]) for p in output.stream(start, end)).decode("utf-8", "replace")}

    return made.select("row", "form", "output").mapInArrow(_batches(each, schema), schema)


def digests(made: DataFrame) -> DataFrame:
    """``row, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``: digests of results, and of the texts rebuilt from them."""
    schema = _schema(made.schema["row"], "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")

    def each(r: dict) -> dict:
        output = _frames(r["output"])
        own = {c: r[c] for c in ("n", "form", "prefix_chars", "middle_chars")}
        return own | {"output_sha256": output.digest(), "restored_sha256": output.digest(*ranges(output, r["form"]))}

    return made.mapInArrow(_batches(each, schema), schema)


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """Documents stored as frames in the shared folder, and their results from there."""
    return transform(written(store(docs, **options), "text-frames"))

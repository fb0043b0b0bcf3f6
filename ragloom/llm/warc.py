"""WARC archives, index first.

Writing makes archives of gzip members, one for each record, and an index: file, offset, length, URL and
digest of every record. Reading starts from the index alone: the records that are wanted are chosen there, their
byte ranges are sorted, neighbouring ranges are read in one go, and only those bytes are touched.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, new_path, tidied, written

#: Payloads below this many bytes are always written in full.
LEAST_SHARED_BYTES = 100
#: Archives end at about this size; ranges closer than GAP are read together, up to READ_BYTES.
ARCHIVE_BYTES, READ_BYTES, GAP = 64 << 20, 8 << 20, 64 << 10

INDEX = "page_id {kind}, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _record_id(page_id: str | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(kind: str, url: str, page_id: str | None, digest: str, size: int, payload: bytes, refers_to: str = "", refers_url: str = "") -> bytes:
    """One uncompressed WARC/1.1 record. A revisit's block is empty; its headers name the full payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, url)}",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, refers_url)}", f"WARC-Refers-To-Target-URI: {refers_url}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _clean(url: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in url or "")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives below ``path`` and returns the index, a table in the shared folder.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least :data:`LEAST_SHARED_BYTES` bytes the
    one with the smallest id is a response and the others revisit it; repeated rows of
    that id are responses too, and share its record id. Rows with a null id are responses, and none refers to them. Pages of any
    length are written whole; an empty table gives an empty index; other columns are ignored. Digests of all pages are compared by a shuffle of ids and digests;
    the pages themselves move once, by id.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_html"), F.col(f"`{url_col}`").alias("url"))
    keyed = slim.select("page_id", "url", "_html", F.sha2("_html", 256).alias("digest"), F.octet_length("_html").alias("size"))
    shared = keyed.filter((F.col("size") >= LEAST_SHARED_BYTES) & F.col("page_id").isNotNull())
    firsts = shared.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = written(firsts, "warc-firsts")  # so that the join below shuffles both sides and a hot digest can be split
    revisits = shared.select("page_id", "digest").join(firsts, "digest").filter("page_id <> first.page_id").select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()
    # a page's payload leads its revisit row: repeated ids with other payloads stay apart
    roles = keyed.join(revisits.withColumnRenamed("digest", "_digest").withColumnRenamed("page_id", "_page_id"), (F.col("page_id") == F.col("_page_id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = roles.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("_html")).alias("html"), "digest", "size", F.col("refers_to").cast("string"), "refers_url").sortWithinPartitions("page_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = stream = None
        at, name = 0, ""
        try:
            for batch in batches:
                files, offsets, lengths, kinds = [], [], [], []
                for page, url, html, digest, size, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        system, inner = filesystem(path)
                        system.create_dir(inner, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out, at = system.open_output_stream(f"{inner}/{name}", compression=None), 0
                    of = "response" if refers is None else "revisit"
                    data = _member(record(of, _clean(url), None if page is None else str(page), digest, size, (html or "").encode(), refers or "", _clean(refers_url)))
                    out.write(data)
                    files.append(f"{path}/{name}")
                    offsets.append(at)
                    lengths.append(len(data))
                    kinds.append(of)
                    at += len(data)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column(3), batch.column(4).cast(pa.int64()), pa.array(kinds, pa.string())],
                    ["page_id", "url", "file", "offset", "length", "payload_digest", "payload_bytes", "record_type"],
                )
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(tidied(each), INDEX.format(kind=kind)), "warc-index")


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, start, end) of reads that cover sorted (offset, length) rows."""
    first = 0
    for i in range(1, len(rows) + 1):
        start, end = rows[first][0], rows[i - 1][0] + rows[i - 1][1]
        if i == len(rows) or rows[i][0] - end > GAP or rows[i][0] + rows[i][1] - start > READ_BYTES:
            yield first, i, start, end
            first = i


RECORDS = "page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, html string"


def read_archives(selected: DataFrame, with_html: bool = True) -> DataFrame:
    """The records that ``selected``, rows of the index, name: as their archives have them.

    A response's digest and size are taken from its payload and compared with the headers. ``refers_to`` is null
    but for revisits, ``html`` null for revisits.
    """
    kind = selected.schema["page_id"].dataType.simpleString()
    files = max(1, selected.select("file").distinct().count())
    rows = selected.select("file", "offset", "length").repartition(files, "file").sortWithinPartitions("file", "offset")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                system, inner = filesystem(files[a])
                with system.open_input_file(inner) as file:
                    for i, j, start, end in _ranges(list(zip(offsets[a:b], lengths[a:b]))):
                        data = file.read_at(end - start, start)
                        found = []
                        for k in range(a + i, a + j):
                            head, block = parse(zlib.decompress(data[offsets[k] - start : offsets[k] - start + lengths[k]], 31))
                            digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                            if head["WARC-Type"] == "response" and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, size):
                                raise ValueError(f"{files[k]} is damaged at {offsets[k]}")
                            full = head["WARC-Type"] == "response"
                            found.append((head.get("X-Page-ID"), head["WARC-Target-URI"], size, digest, head["WARC-Type"], head.get("X-Refers-To-Page-ID"), block.decode() if full and with_html else None))
                        columns = list(zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    found = rows.mapInArrow(tidied(each), RECORDS.format(kind="string"))
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def archive_pages(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes all pages and reads all their records back."""
    return read_archives(write_archives(pages, new_path(spark, "warc")), with_html=False)

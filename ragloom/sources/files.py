"""File formats: each reader turns files into rows ``path, doc_no, document, metadata``.

A file is parsed in one task, files in parallel. Office formats are read with the standard library (ZIP and XML). PDF, text
recognition and captions need engines that are passed in; the stand-ins here are deterministic.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import csv
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.text import FIRST_STEP, STEP, STEP_LINE

SCHEMA = "path string, doc_no int, document string, metadata string"
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
Rows = Iterator[tuple[str, dict]]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def file_name(path: str) -> str:
    return unquote(posixpath.basename(path))


def parse_text(content: bytes, name: str) -> Rows:
    """The whole file as one document."""
    yield content.decode("utf-8-sig", "replace"), {"source": name}


def rendered(header: list[str], values: list[str]) -> str:
    return ", ".join(f"{h}: {v.strip()}" for h, v in zip(header, values) if v and v.strip())


def parse_csv(content: bytes, name: str) -> Rows:
    """A document for each record with a value. Records count from 2, those without values too."""
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))
    header = [h.strip() for h in next(rows, [])]
    for number, values in enumerate(rows, start=2):
        text = rendered(header, values)
        if text:
            yield text, {"source": name, "row": number}


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def parse_xlsx(content: bytes, name: str) -> Rows:
    """The first sheet: its first used row is the header, cells without one are left out, rows count as the sheet counts them."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_S}sheets/{_S}sheet")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheet.get(f"{_R}id")]
        root = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    header: dict[int, str] | None = None
    for at, row in enumerate(root.iter(f"{_S}row"), start=1):
        cells = {}
        for k, cell in enumerate(row.iter(f"{_S}c"), start=1):
            value = cell.findtext(f"{_S}v") or ""
            if cell.get("t") == "s" and value:
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
            if value:
                cells[_column(cell.get("r", "")) or k] = value
        if not cells:
            continue
        if header is None:
            header = {k: v.strip() for k, v in cells.items()}
            continue
        text = ", ".join(f"{header[k]}: {v.strip()}" for k, v in sorted(cells.items()) if k in header and v.strip())
        if text:
            yield text, {"source": name, "row": int(row.get("r", at))}


# Headings within documents.
TEXT_HEADING, PICTURE_HEADING = "[VĂN BẢN HƯỚNG DẪN]", "[MÔ TẢ GIAO DIỆN TỪ HÌNH ẢNH]"


def parse_docx(content: bytes, name: str) -> Rows:
    """A document for each paragraph of the body itself that has text in its runs; tables are left out, paragraphs count from 1, empty ones too."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
    for number, paragraph in enumerate(body.findall(f"{_W}p") if body is not None else [], start=1):
        text = "".join(t.text or "" for run in paragraph.findall(f"{_W}r") for t in run.findall(f"{_W}t")).strip()
        if text:
            yield f"{TEXT_HEADING}\n{text}", {"source": name, "type": "docx_text", "content_kind": "instruction_text", "paragraph_index": number}


_GAP = re.compile(r"[ \t]*\t[ \t]*| {8,}")
_BUTTON = ("nút", "nut")


def clean_slide_text(text: str) -> str:
    """Gaps on a slide stand for a button: a space if the word is near before it, else the word; then spaces are squeezed."""
    whole = text.replace("\r\n", "\n").replace("\r", "\n")

    def fill(match: re.Match) -> str:
        near = whole[: match.start()].rstrip()[-25:].lower()
        return " " if any(b in near for b in _BUTTON) else " nút "

    squeezed = re.sub(r"[ \f\v]+", " ", _GAP.sub(fill, whole))
    return re.sub(r" *\n *", "\n", squeezed).strip()


# the patterns of the Column functions; letters and digits of all scripts count here without a flag
_STEP_LINE, _STEPS, _FIRST = (re.compile(p.replace("(?iU)", "(?i)")) for p in (STEP_LINE, STEP, FIRST_STEP))


def slide_title(texts: list[str]) -> str | None:
    """The first line that names the procedure document, else the first one; lines of steps are no titles."""
    from ragloom.operators.context import folded

    candidates = [line.strip() for t in texts for line in t.split("\n") if line.strip() and not _STEP_LINE.search(line)]
    return next((c for c in candidates if "to trinh nghiep vu" in folded(c)), candidates[0] if candidates else None)


def procedure_blocks(text: str) -> list[str]:
    if not _STEPS.search(text):
        return []
    starts = [m.start() for m in _FIRST.finditer(text)]
    if len(starts) <= 1:
        return [text.strip()]
    return [b for b in (text[i:j].strip() for i, j in zip(starts, [*starts[1:], len(text)])) if b]


def action_of(text: str | None) -> str | None:
    """What :func:`ragloom.functions.intent.action_kind` answers, for one text."""
    from ragloom.functions.intent import ACTIONS
    from ragloom.operators.context import folded

    plain = folded(text or "")
    for phrase in sorted(ACTIONS, key=len, reverse=True):
        if re.search(r"\bin\b" if phrase == "in" else rf"(^|\s){phrase}(\s|$)", plain):
            return ACTIONS[phrase]
    return None


def _paragraphs(element) -> str:
    texts = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in element.iter(f"{_A}p")]
    return clean_slide_text("\n".join(clean_slide_text(t) for t in texts if t.strip()))


def _walk(tree) -> Iterator[str]:
    """Texts in order: of each shape, of each row of a table with bars between cells, and of what groups hold."""
    for element in tree:
        if element.tag == f"{_P}graphicFrame" and element.find(f".//{_A}tbl") is not None:
            for row in element.find(f".//{_A}tbl").iter(f"{_A}tr"):
                yield " | ".join(c for c in map(_paragraphs, row.iter(f"{_A}tc")) if c)
        elif element.tag in (f"{_P}sp", f"{_P}graphicFrame"):
            yield _paragraphs(element)
        elif element.tag == f"{_P}grpSp":
            yield from _walk(element)


def _slides(package: zipfile.ZipFile) -> list:
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(package.read("ppt/_rels/presentation.xml.rels"))}
    order = [posixpath.normpath(posixpath.join("ppt", targets[s.get(f"{_R}id")])) for s in ElementTree.fromstring(package.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
    return [ElementTree.fromstring(package.read(n)).find(f"{_P}cSld/{_P}spTree") for n in order]


def _plain_slides(package: zipfile.ZipFile, name: str) -> Rows:
    """Slides by the number in their name, as their paragraphs' text alone."""
    found = sorted((n for n in package.namelist() if re.fullmatch(r"ppt/slides/slide[^/]*\.xml", n, re.I)), key=lambda n: int((re.search(r"(\d+)\.xml$", n) or [0, 1 << 31])[1]))
    for number, n in enumerate(found, start=1):
        text = _paragraphs(ElementTree.fromstring(package.read(n)))
        if text:
            yield f"{TEXT_HEADING}\n{text}", {"source": name, "slide": number, "type": "pptx_slide_text_fallback", "content_kind": "instruction_text"}


def parse_pptx(content: bytes, name: str) -> Rows:
    """Blocks of instructions of each slide in the order of the presentation; without that order, the slides' text alone.

    Each shape and each row of a table is instructions of its own: blocks of steps, or else details.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        try:
            trees = _slides(package)
        except (KeyError, ElementTree.ParseError):
            yield from _plain_slides(package, name)
            return
    for number, tree in enumerate(trees, start=1):
        if tree is None:
            continue
        title = slide_title([t for t in (_paragraphs(e) for e in tree if e.tag == f"{_P}sp") if t])
        heading = (f"[SLIDE: {title}]\n" if title else "") + TEXT_HEADING
        for text in filter(None, map(clean_slide_text, _walk(tree))):
            blocks = procedure_blocks(text)
            for block in blocks or [text]:
                own = {"source": name, "slide": number, "type": "pptx_slide", "content_kind": "instruction_text", "instruction_role": "procedure_steps" if blocks else "ui_details"}
                action = action_of(block) or action_of(title)
                own |= {k: v for k, v in (("slide_title", title), ("action_kind", action), ("step_count", len(_STEPS.findall(block)))) if v}
                yield f"{heading}\n{block}", own


def nothing(content: bytes, name: str) -> Rows:
    """Stand-in of a parser whose engine is missing: no documents."""
    return iter(())


PARSERS: dict[str, Callable[[bytes, str], Rows]] = {"txt": parse_text, "md": parse_text, "csv": parse_csv, "xlsx": parse_xlsx, "docx": parse_docx, "pptx": parse_pptx}


def extension(path) -> object:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


PARSED = SCHEMA + ", error string"


def parsed(files: DataFrame, parsers: dict[str, Callable[[bytes, str], Rows]] | None = None) -> DataFrame:
    """``path, doc_no, document, metadata, error`` of files ``path, content``; files of other kinds have no rows.

    ``parsers`` adds or replaces parsers by extension, as for PDF and images. A file whose parser fails has what was read before, as with a stream of documents, and a
    row with the error, without document. Content that is null is not read.
    """
    of = PARSERS | (parsers or {})
    some = files.filter(extension(F.col("path")).isin(list(of)) & F.col("content").isNotNull()).select("path", "content")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                name = file_name(path)
                rows = []
                try:
                    for number, (text, metadata) in enumerate(of[name.rsplit(".", 1)[-1].lower()](bytes(content), name)):
                        rows.append((path, number, text, json.dumps(metadata, ensure_ascii=False), None))
                except Exception as failed:  # whatever a parser or its engine raises concerns its file alone
                    rows.append((path, len(rows), None, None, f"{type(failed).__name__}: {failed}"))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "doc_no", "document", "metadata", "error"])

    return some.mapInPandas(each, PARSED)


def read_documents(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes, str], Rows]] | None = None) -> DataFrame:
    """All documents of the files in ``folder`` (see :func:`parsed`); of broken files, what was read before."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return parsed(files, parsers).filter("error is null").drop("error")


def first_recognised(image: bytes, variants: list[Callable[[bytes], bytes]], languages: tuple[str, ...], recognise: Callable[[bytes, str], str]) -> str:
    """The first text that is not blank, over the variants of an image and, for each, the languages."""
    for variant in variants:
        changed = variant(image)
        for language in languages:
            text = recognise(changed, language)
            if text and text.strip():
                return text.strip()
    return ""


def image_parser(size: Callable[[bytes], tuple[int, int] | None], recognise: Callable[[bytes], str], caption: Callable[[bytes, str], str | None] | None = None, useful: Callable[[str | None], bool] = bool) -> Callable[[bytes, str], Rows]:
    """A parser of images from engines: an image without text and without a useful caption has no document, nor has one that cannot be decoded."""

    def parse(content: bytes, name: str) -> Rows:
        sides = size(content)
        if sides is None:
            return
        text = recognise(content) or ""
        said = caption(content, text) if caption else None
        said = said if useful(said) else None
        if not text.strip() and not (said or "").strip():
            return
        parts = [f"Image dimensions: {sides[0]}x{sides[1]}px."] + [f"OCR text: {text}"] * bool(text.strip()) + [f"Vision caption: {said}"] * bool(said)
        yield "\n".join(parts), {"source": name, "type": "image", "width": sides[0], "height": sides[1], "has_ocr_text": bool(text.strip()), "caption_source": "ocr+vision" if said else "ocr"}

    return parse


#: Words below which a page counts as scanned.
LEAST_PAGE_WORDS = 10


def pdf_parser(pages: Callable[[bytes], Iterator[tuple[str, bytes, int, int]]], recognise: Callable[[bytes], str], caption: Callable[[bytes, str], str | None] | None = None, useful: Callable[[str | None], bool] = bool) -> Callable[[bytes, str], Rows]:
    """A parser of PDF from engines; ``pages`` gives each page's text, its picture and the picture's sides.

    A page with few words is scanned: its text is recognised in the picture, and the picture may be described.
    """

    def parse(content: bytes, name: str) -> Rows:
        images = 0
        for number, (text, picture, width, height) in enumerate(pages(content), start=1):
            if len((text or "").split()) >= LEAST_PAGE_WORDS:
                yield f"{TEXT_HEADING}\n{text.strip()}", {"source": name, "page": number, "type": "pdf_text", "content_kind": "instruction_text"}
                continue
            found = recognise(picture) or ""
            if found.strip():
                yield f"{TEXT_HEADING}\n{found}", {"source": name, "page": number, "type": "pdf_scanned_text", "content_kind": "instruction_text"}
            if caption:
                images += 1
                said = caption(picture, found)
                if useful(said):
                    own = {"type": "pdf_scanned_image", "content_kind": "image_ui_description", "image_index": images, "width": width, "height": height, "image_role": "scanned_page"}
                    yield f"{PICTURE_HEADING}\n[Trang tài liệu scan: Vision caption: {said}]", {"source": name, "page": number, **own}

    return parse

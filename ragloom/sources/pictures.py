"""Word documents and presentations with their images.

Files are taken apart once, into elements in reading order and a table of images by digest. Each different image is recognised once and, if a place where it
stands is within the limits of its file and slide, captioned once. What was found is joined back to the places: small images become
markers within the text, large ones a placeholder there and a description of their own.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import generated, intent, text
from ragloom.operators.chunking import vision_budget
from ragloom.operators.versions import stable

from .engines import HINT_CHARS, Engines, called
from .files import _A, _P, _R, _W, PARSED, PICTURE_HEADING, TEXT_HEADING, _paragraphs, clean_slide_text, extension, file_name, slide_title

# The wording of descriptions.
ON_SLIDE, IN_DOCUMENT = "Hình ảnh trên slide", "Hình ảnh trong tài liệu"
UNRELIABLE = "Vision caption was empty or filtered as unreliable"

ELEMENTS = "path string, part int, seq int, words string, digest string, width int, height int, floating boolean, title string, content binary, error string"
_D = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"


def dimensions(content: bytes) -> tuple[int, int] | None:
    """The sides of a PNG, JPEG, GIF or BMP image from its header; None for anything else."""
    try:
        if content.startswith(b"\x89PNG\r\n\x1a\n"):
            return struct.unpack(">II", content[16:24])
        if content[:4] == b"GIF8":
            return struct.unpack("<HH", content[6:10])
        if content[:2] == b"BM":
            width, height = struct.unpack("<ii", content[18:26])
            return width, abs(height)
        if content[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(content):
                if content[at] != 0xFF:
                    return None
                kind = content[at + 1]
                if kind == 0xFF:
                    at += 1
                    continue
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                    return width, height
                at += 2 + (0 if 0xD0 <= kind <= 0xD8 else struct.unpack(">H", content[at + 2 : at + 4])[0])
    except struct.error:
        pass
    return None


def _relations(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    at = f"{folder}/_rels/{name}.rels"
    if at not in package.namelist():
        return {}
    inside = [r for r in ElementTree.fromstring(package.read(at)) if r.get("TargetMode") != "External"]
    return {r.get("Id"): r.get("Target").lstrip("/") if r.get("Target").startswith("/") else posixpath.normpath(posixpath.join(folder, r.get("Target"))) for r in inside}


def _picture(package: zipfile.ZipFile, relations: dict[str, str], blip) -> bytes | None:
    target = relations.get(blip.get(f"{_R}embed") or "") if blip is not None else None
    return package.read(target) if target in package.namelist() else None


def docx_elements(package: zipfile.ZipFile) -> Iterator[tuple]:
    """``paragraph, text, image, floating, title`` in reading order; paragraphs count from 1, tables are left out."""
    relations = _relations(package, "word/document.xml")
    body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
    for number, paragraph in enumerate(body.findall(f"{_W}p") if body is not None else [], start=1):
        for run in paragraph.findall(f"{_W}r"):
            words = "".join(t.text or "" for t in run.findall(f"{_W}t"))
            if words:
                yield number, words, None, False, None
            for drawing in run.findall(f"{_W}drawing"):
                image = _picture(package, relations, drawing.find(f".//{_A}blip"))
                if image is not None:
                    yield number, None, image, drawing.find(f".//{_D}anchor") is not None, None


def pptx_elements(package: zipfile.ZipFile) -> Iterator[tuple]:
    """The same of slides: texts of shapes and table rows, and pictures, also within groups; slides count from 1 in their order."""
    slides = _relations(package, "ppt/presentation.xml")
    order = [slides[s.get(f"{_R}id")] for s in ElementTree.fromstring(package.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
    for number, name in enumerate(order, start=1):
        tree, relations = ElementTree.fromstring(package.read(name)).find(f"{_P}cSld/{_P}spTree"), _relations(package, name)
        if tree is None:
            continue
        title = slide_title([t for t in (_paragraphs(e) for e in tree if e.tag == f"{_P}sp") if t])

        def walk(elements) -> Iterator[tuple]:
            for e in elements:
                if e.tag == f"{_P}pic":
                    image = _picture(package, relations, e.find(f"{_P}blipFill/{_A}blip"))  # noqa: B023
                    if image is not None:
                        yield None, image
                elif e.tag == f"{_P}grpSp":
                    yield from walk(e)
                elif e.tag == f"{_P}graphicFrame" and e.find(f".//{_A}tbl") is not None:
                    for row in e.find(f".//{_A}tbl").iter(f"{_A}tr"):
                        yield " | ".join(c for c in map(_paragraphs, row.iter(f"{_A}tc")) if c), None
                elif e.tag in (f"{_P}sp", f"{_P}graphicFrame"):
                    yield _paragraphs(e), None

        for words, image in walk(tree):
            if image is not None or words:
                yield number, words, image, False, title


def elements(files: DataFrame) -> DataFrame:
    """:data:`ELEMENTS` of the Word and PowerPoint files of ``path, content``. Images that cannot be decoded are left out; a broken file gives what was read before and a row with its error."""
    some = files.filter(extension(F.col("path")).isin("docx", "pptx") & F.col("content").isNotNull()).select("path", "content")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as package:
                        for part, words, image, floating, title in (docx_elements if path.lower().endswith("docx") else pptx_elements)(package):
                            sides = dimensions(image) if image is not None else None
                            if image is None or sides:
                                rows.append((path, part, len(rows), words, hashlib.sha256(image).hexdigest() if sides else None, *(sides or (None, None)), floating, title, image, None))
                except Exception as failed:  # whatever a file holds concerns it alone
                    rows.append((path, None, len(rows), None, None, None, None, None, None, None, f"{type(failed).__name__}: {failed}"))
                for at in range(0, len(rows), 64):  # images may be large
                    yield pd.DataFrame(rows[at : at + 64], columns=[f.split()[0] for f in ELEMENTS.split(", ")]).astype({c: "Int32" for c in ("part", "width", "height")})

    return some.mapInPandas(each, ELEMENTS)


def described(places: DataFrame, images: DataFrame, engines: Engines) -> DataFrame:
    """``places`` (path, part, seq, digest, width, height, slide) with ``image_index``, ``ocr``, ``role``, ``tried`` and ``caption``.

    ``images`` (digest, content) has each image once. An image is captioned if one of its places is granted an attempt; every place that is granted one has it.
    """
    sized = images.join(places.groupBy("digest").agg(F.first("width").alias("width"), F.first("height").alias("height")), "digest")
    limits = {"most": engines.concurrent, "seconds": engines.seconds}
    read = stable(called(sized, "ocr", engines.recognise, "content", when=~generated.skip_recognition(F.col("width"), F.col("height")), **limits).drop("content"), "recognised")
    of = Window.partitionBy("path", F.when(F.col("slide"), F.col("part"))).orderBy("seq")
    met = places.withColumn("image_index", F.row_number().over(of)).join(read.select("digest", "ocr"), "digest")
    met = met.withColumn("role", generated.image_role(F.col("width"), F.col("height"), F.col("ocr"), engines.least_width, engines.least_height, F.col("floating")))
    large = (F.col("width") >= engines.least_width) & (F.col("height") >= engines.least_height)
    wants = large if engines.caption else F.lit(False)
    budget = vision_budget(met.withColumn("eligible", wants), engines.per_file, engines.per_slide, file="path", slide="part", order="seq")
    # paragraphs are no slides: only a presentation's images are limited
    tried = stable(budget.withColumn("tried", F.when(F.col("slide"), F.col("granted")).otherwise(F.col("eligible"))).drop("granted", "eligible"), "places")
    if not engines.caption:
        return tried.withColumn("caption", F.lit(None).cast("string"))
    asked = images.join(tried.filter("tried").select("digest").distinct(), "digest").join(read.select("digest", F.substring("ocr", 1, HINT_CHARS).alias("hint")), "digest")
    said = called(asked, "caption", engines.caption, "content", "hint", **limits).select("digest", "caption")
    said = stable(said.withColumn("caption", F.when(generated.caption_is_useful(F.col("caption")), F.col("caption"))), "captions")
    return tried.join(said, "digest", "left").withColumn("caption", F.when(F.col("tried"), F.col("caption")))


def _description(where: Column) -> Column:
    """The document of a large image; null if nothing is known of it and nothing was tried."""
    ocr, caption = F.col("ocr"), F.col("caption")
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("dimensions: "), F.col("width"), F.lit("x"), F.col("height"), F.lit("px")),
            F.when(~text.is_blank(ocr), F.concat(F.lit("OCR text: "), ocr)),
            F.when(caption.isNotNull(), F.concat(F.lit("Vision caption: "), caption)).when(F.col("tried") & text.is_blank(ocr), F.lit(UNRELIABLE)),
        )
    )
    return F.when((F.size(parts) > 1) | F.col("tried"), F.concat(F.lit(PICTURE_HEADING + "\n["), where, F.lit(": "), F.array_join(parts, "; "), F.lit("]")))


def office_documents(files: DataFrame, engines: Engines) -> DataFrame:
    """``path, doc_no, document, metadata, error`` of the Word and PowerPoint files of ``path, content``, images included.

    Of a Word file the paragraphs come in order and then the descriptions of images; of a presentation each slide's instructions and then its
    images, which have the slide's title and action. A file without content has no rows.
    """
    all_ = stable(elements(files), "elements")
    slide = extension(F.col("path")) == "pptx"
    images = all_.filter("digest is not null").groupBy("digest").agg(F.first("content").alias("content"))
    places = all_.filter("digest is not null").drop("content", "words", "error").withColumn("slide", slide)
    pictures = stable(described(places, images, engines), "pictures").withColumn("icon", F.col("role") == generated.ICON)
    cleaned = F.udf(clean_slide_text, "string")
    marker = F.when(F.col("icon"), generated.inline_marker(F.col("ocr"))).otherwise(generated.SCREENSHOT_MARK)
    inline = pictures.select("path", "part", "seq", "slide", "title", marker.alias("words")).filter("words is not null")
    inline = inline.withColumn("words", F.when(F.col("slide"), cleaned("words")).otherwise(F.concat(F.lit(" "), F.col("words"), F.lit(" "))))
    words = all_.filter("words is not null").select("path", "part", "seq", slide.alias("slide"), "title", "words").unionByName(inline)

    source = F.udf(file_name, "string")("path")
    lines = words.filter(~F.col("slide")).groupBy("path", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "words"))), lambda x: x["words"]), "").alias("words"))
    paragraphs = lines.select("path", "part", text.trim_space(F.col("words")).alias("words")).filter("words <> ''")
    instruction = F.lit("instruction_text")
    in_word = paragraphs.select(
        "path", F.lit(0).alias("o1"), F.col("part").alias("o2"), F.lit(0).alias("o3"), F.concat(F.lit(TEXT_HEADING + "\n"), "words").alias("document"),
        F.to_json(F.struct(source.alias("source"), F.lit("docx_text").alias("type"), instruction.alias("content_kind"), F.col("part").alias("paragraph_index"))).alias("metadata"),
    )
    own = text.procedure_blocks(F.col("words"))
    role = F.when(F.size(own) > 0, "procedure_steps").otherwise("ui_details")
    blocks = words.filter("slide").select("path", "part", "seq", "title", role.alias("role"), F.posexplode(F.when(F.size(own) > 0, own).otherwise(F.array("words"))).alias("k", "block")).filter(~text.is_blank(F.col("block")))
    action, steps = F.coalesce(intent.action_kind(F.col("block")), intent.action_kind(F.col("title"))), text.count_steps(F.col("block"))
    heading = F.concat(F.when(F.col("title").isNotNull(), F.concat(F.lit("[SLIDE: "), "title", F.lit("]\n"))).otherwise(""), F.lit(TEXT_HEADING + "\n"))
    on_slides = blocks.select(
        "path", F.col("part").alias("o1"), F.lit(0).alias("o2"), (F.col("seq") * 1000000 + F.col("k")).alias("o3"), F.concat(heading, "block").alias("document"),
        F.to_json(F.struct(source.alias("source"), F.col("part").alias("slide"), F.lit("pptx_slide").alias("type"), instruction.alias("content_kind"), F.col("role").alias("instruction_role"), F.col("title").alias("slide_title"), action.alias("action_kind"), F.when((F.col("role") == "procedure_steps") & (steps > 0), steps).alias("step_count"))).alias("metadata"),
    )
    seen = pictures.filter(~F.col("icon")).withColumn("document", F.when(F.col("slide"), _description(F.lit(ON_SLIDE))).otherwise(_description(F.lit(IN_DOCUMENT)))).filter("document is not null")
    image = F.lit("image_ui_description")
    of_word = F.struct(source.alias("source"), F.lit("docx_image").alias("type"), image.alias("content_kind"), F.col("part").alias("paragraph_index"), "image_index", F.when(F.col("floating"), "floating").otherwise("inline_large").alias("image_role"), "width", "height")
    of_slide = F.struct(source.alias("source"), F.col("part").alias("slide"), F.lit("pptx_slide_image").alias("type"), image.alias("content_kind"), "image_index", "width", "height", F.lower("role").alias("image_role"), F.col("title").alias("slide_title"), intent.action_kind(F.col("title")).alias("action_kind"))
    shown = seen.select("path", F.when(F.col("slide"), F.col("part")).otherwise(1).alias("o1"), F.when(F.col("slide"), 1).otherwise(F.col("part")).alias("o2"), F.col("seq").alias("o3"), "document", F.when(F.col("slide"), F.to_json(of_slide)).otherwise(F.to_json(of_word)).alias("metadata"))
    every = in_word.unionByName(on_slides).unionByName(shown).withColumn("error", F.lit(None).cast("string"))
    failed = all_.filter("error is not null").select("path", F.lit(1 << 30).alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3"), F.lit(None).cast("string").alias("document"), F.lit(None).cast("string").alias("metadata"), "error")
    number = F.row_number().over(Window.partitionBy("path").orderBy("o1", "o2", "o3")) - 1
    return every.unionByName(failed).withColumn("doc_no", number).select(*(f.split()[0] for f in PARSED.split(", ")))

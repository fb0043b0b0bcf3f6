"""Images within Word files and presentations, and engines that are slow or fail."""

import io
import json
import struct
import threading
import time
import zipfile
import zlib

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ragloom.sources import engines, pictures

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not see this module


def png(width, height, shade=0):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + bytes([shade]) * width) * height)) + chunk(b"IEND", b"")


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
ICON, LONG, SCREEN, SCREEN2, TINY = png(40, 30), png(60, 50), png(400, 300, 1), png(400, 300, 2), png(10, 30)


def run(words):
    return f"<w:r><w:t>{words}</w:t></w:r>"


def drawing(name, anchor=False):
    kind = "anchor" if anchor else "inline"
    return f'<w:r><w:drawing><wp:{kind}><a:graphic><a:blip r:embed="{name}"/></a:graphic></wp:{kind}></w:drawing></w:r>'


def relations(**targets):
    return '<Relationships xmlns="x">' + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def docx():
    body = f"<w:p>{run('Bấm ')}{drawing('i')}{run('để lưu')}</w:p><w:p/><w:p>{drawing('s')}</w:p><w:p>{run('sau')}{drawing('i', True)}{drawing('no')}{drawing('bad')}</w:p>"
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": relations(i="media/i.png", s="media/s.png", bad="media/b.png"), "word/media/i.png": ICON, "word/media/s.png": SCREEN, "word/media/b.png": b"no image"}
    return archive(parts)


def pptx():
    shape = lambda *t: "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:txBody></p:sp>"
    pic = lambda k: f'<p:pic><p:blipFill><a:blip r:embed="{k}"/></p:blipFill></p:pic>'
    slide = lambda body: f"<p:sld {P}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    own = relations(a="../media/a.png", b="../media/b.png", c="../media/c.png", l="../media/l.png", t="../media/t.png")
    return archive(
        {
            "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId r:id="x"/><p:sldId r:id="y"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": relations(x="slides/one.xml", y="slides/two.xml"),
            "ppt/slides/one.xml": slide(shape("Phê duyệt") + pic("a") + f"<p:grpSp>{pic('c')}{shape('Bước 1: mở', 'Bước 2: lưu')}</p:grpSp>" + pic("b") + pic("t")),
            "ppt/slides/two.xml": slide(shape("Khác") + pic("b") + pic("b") + pic("l")),
            "ppt/slides/_rels/one.xml.rels": own,
            "ppt/slides/_rels/two.xml.rels": own,
            "ppt/media/a.png": SCREEN, "ppt/media/b.png": SCREEN2, "ppt/media/c.png": ICON, "ppt/media/l.png": LONG, "ppt/media/t.png": TINY,
        }
    )


SAID = "Màn hình có bảng tìm kiếm với nút lưu và các cột trạng thái, ngày tạo."


def recognise(image):
    return {ICON: " Lưu\tlại ", LONG: "một dòng chữ rất dài " * 4, SCREEN: "chữ"}.get(image)


def caption(image, hint):
    return SAID + (f" ({hint})" if hint else "") if image != SCREEN2 else "vô ích"


def documents(spark, tmp_path, files, **options):
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    read = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    rows = pictures.office_documents(read, engines.Engines(recognise, **options)).orderBy("path", "doc_no").collect()
    assert [r.doc_no for r in rows] == [k for n in sorted(files) for k in range(sum(r.path.endswith(n) for r in rows))]
    return [(r.document, json.loads(r.metadata) if r.metadata else r.error) for r in rows]


TEXT, PICTURE = "[VĂN BẢN HƯỚNG DẪN]\n", "[MÔ TẢ GIAO DIỆN TỪ HÌNH ẢNH]\n"


def test_a_word_file(spark, tmp_path):
    found = documents(spark, tmp_path, {"x.docx": docx()}, caption=caption)
    base = {"source": "x.docx", "type": "docx_image", "content_kind": "image_ui_description"}
    assert found == [
        (TEXT + "Bấm  [Nút/Ảnh: Lưu\tlại] để lưu", {"source": "x.docx", "type": "docx_text", "content_kind": "instruction_text", "paragraph_index": 1}),
        (TEXT + "[Ảnh giao diện]", {"source": "x.docx", "type": "docx_text", "content_kind": "instruction_text", "paragraph_index": 3}),
        (TEXT + "sau [Ảnh giao diện]", {"source": "x.docx", "type": "docx_text", "content_kind": "instruction_text", "paragraph_index": 4}),
        (PICTURE + f"[Hình ảnh trong tài liệu: dimensions: 400x300px; OCR text: chữ; Vision caption: {SAID} (chữ)]", base | {"paragraph_index": 3, "image_index": 2, "image_role": "inline_large", "width": 400, "height": 300}),
        (PICTURE + "[Hình ảnh trong tài liệu: dimensions: 40x30px; OCR text: Lưu\tlại]", base | {"paragraph_index": 4, "image_index": 3, "image_role": "floating", "width": 40, "height": 30}),
    ]


def test_a_presentation_within_its_limits(spark, tmp_path):
    found = documents(spark, tmp_path, {"y.pptx": pptx(), "z.docx": b"broken", "a.txt": b"no"}, caption=caption, per_slide=1, per_file=2)
    head = "[SLIDE: Phê duyệt]\n" + TEXT
    texts = [(t, m["slide"], m.get("instruction_role"), m.get("action_kind"), m.get("step_count")) for t, m in found[:-1] if m["content_kind"] == "instruction_text"]
    assert texts == [
        (head + "Phê duyệt", 1, "ui_details", "duyet", None),
        (head + "[Ảnh giao diện]", 1, "ui_details", "duyet", None),
        (head + "[Nút/Ảnh: Lưu lại]", 1, "ui_details", "duyet", None),  # a tab beside the word stands for no button
        (head + "Bước 1: mở\nBước 2: lưu", 1, "procedure_steps", "duyet", 2),
        (head + "[Ảnh giao diện]", 1, "ui_details", "duyet", None),
        ("[SLIDE: Khác]\n" + TEXT + "Khác", 2, "ui_details", None, None),
        *[("[SLIDE: Khác]\n" + TEXT + "[Ảnh giao diện]", 2, "ui_details", None, None)] * 3,
    ]
    images = [(t.split("\n")[1], m["slide"], m["image_index"], m["image_role"], m.get("action_kind")) for t, m in found[:-1] if m["type"] == "pptx_slide_image"]
    assert images == [
        (f"[Hình ảnh trên slide: dimensions: 400x300px; OCR text: chữ; Vision caption: {SAID} (chữ)]", 1, 1, "uiscreenshot", "duyet"),
        # the slide's limit: the second large image is not tried, and without text it has no description
        ("[Hình ảnh trên slide: dimensions: 400x300px; Vision caption was empty or filtered as unreliable]", 2, 1, "uiscreenshot", None),
        (f"[Hình ảnh trên slide: dimensions: 60x50px; OCR text: {('một dòng chữ rất dài ' * 4).strip()}]", 2, 3, "unknownimage", None),
    ]
    assert found[-1][0] is None and "BadZipFile" in found[-1][1]
    order = [(m["slide"], m["type"]) for _, m in found[:-1]]
    assert order == sorted(order, key=lambda x: (x[0], x[1] == "pptx_slide_image"))


def test_each_image_is_read_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    files = tmp_path / "files"
    files.mkdir()

    def counted(image, hint):
        (log / f"{zlib.crc32(image)}-{time.monotonic_ns()}").touch()
        return SAID

    documents(spark, files, {"x.docx": docx(), "y.pptx": pptx(), "y2.pptx": pptx()}, caption=counted)
    assert sorted(len([1 for p in log.iterdir() if p.name.startswith(f"{zlib.crc32(i)}-")]) for i in (SCREEN, SCREEN2)) == [1, 1]
    assert len(list(log.iterdir())) == 2


def test_ingestion_with_images(spark, tmp_path):
    from ragloom.streaming import files

    for name, content in {"y.pptx": pptx(), "x.docx": docx(), "n.txt": b"note"}.items():
        (tmp_path / name).write_bytes(content)
    read = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("modificationTime").alias("modified"), "length", "content")
    rows = files.prepared(read, engines=engines.Engines(recognise, caption)).collect()
    kinds = {(r.source, json.loads(r.metadata)["type"] if "type" in r.metadata else None) for r in rows}
    assert kinds == {("y.pptx", "pptx_slide"), ("y.pptx", "pptx_slide_image"), ("x.docx", "docx_text"), ("x.docx", "docx_image"), ("n.txt", None)}
    assert all(r.error is None and len(r.embedding) == 64 for r in rows) and len({r.id for r in rows}) == len(rows)


def test_without_captions(spark, tmp_path):
    found = documents(spark, tmp_path, {"x.docx": docx()})
    assert [t.split("\n")[1] for t, m in found if m["type"] == "docx_image"] == ["[Hình ảnh trong tài liệu: dimensions: 400x300px; OCR text: chữ]", "[Hình ảnh trong tài liệu: dimensions: 40x30px; OCR text: Lưu\tlại]"]


def test_calls_at_once_and_in_time():
    lock, now, most = threading.Lock(), [0], [0]

    def call(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(2.0 if k == 2 else 0.1)
        with lock:
            now[0] -= 1
        if k == 5:
            raise ValueError("no")
        return k

    began = time.monotonic()
    assert engines.in_time([lambda k=k: call(k) for k in range(9)], most=3, seconds=0.6) == [0, 1, None, 3, 4, None, 6, 7, 8]
    assert most[0] <= 4 and now[0] == 1 and time.monotonic() - began < 1.5  # the one that is too slow keeps no place


def test_called_on_rows(spark):
    def engine(word, hint):
        if word == "slow":
            time.sleep(5)
        if word == "bad":
            raise RuntimeError("engine")
        return f" {word}{hint or ''} " if word else " "

    rows = spark.createDataFrame([(1, "a", "h"), (2, "slow", None), (3, "bad", None), (4, "", None), (5, "b", None), (6, "c", None)], "k int, word string, hint string").coalesce(1)
    out = engines.called(rows, "said", engine, "word", "hint", when=F.col("k") != 6, most=2, seconds=0.5).orderBy("k").collect()
    assert [r.said for r in out] == ["ah", None, None, None, "b", None]


def test_recogniser_takes_the_first_text_of_variants():
    seen = []

    def engine(pixels, language):
        seen.append((pixels.shape, language))
        if len(seen) == 1:
            raise OSError("no such language")
        return " chữ\n---\n" if len(seen) == 5 else " \n"

    read = engines.recogniser(lambda image: np.zeros((4, 1300, 3), np.uint8) if image else None, engine, ("eng+vie", "vie", "eng"))
    assert read(b"x") == "chữ" and [s[1] for s in seen] == ["eng+vie", "vie", "eng", "eng+vie", "vie"] and seen[3][0] == (84, 1380, 3)
    assert read(b"") is None


def test_dimensions():
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 9
    assert pictures.dimensions(png(3, 4)) == (3, 4) and pictures.dimensions(jpeg) == (40, 30) and pictures.dimensions(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert pictures.dimensions(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -8)) == (7, 8)
    assert [pictures.dimensions(x) for x in (b"", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"text", jpeg[:12])] == [None] * 5

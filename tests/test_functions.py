"""Column functions against plain versions and known cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from ragloom.functions import generated, intent, structured, text
from ragloom.operators import context
from ragloom.plans.fixtures import MESSAGES

RECORDS = [
    'Mã số ID: 20110123, Họ tên: Nguyễn Văn An, Email: an.nguyen@example.com, Lớp: CNTT1',
    'Mã số ID: 20110124, Họ: Trần, Tên: Thị Bình, Email: binh@example.com, Lớp: CNTT2',
    'MSSV: 20110125, Name: "Lê, Minh Châu", Mail: chau@example.com, Class: KT1',
    "Ten sinh vien: Phạm Dung, Lop: KT2, Mã ID: 20110126",
    "no record here", "a:, :b, c:d, C: e, c : f", 'x: "1, 2, y: 3, z: 4', "", "Địa chỉ thư điện tử: hoa@example.com, Họ và tên: Hoa Mai, Student ID: 20110127",
]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", f(F.col("v"))).collect())]


def plain_chunks(t, size, overlap):
    if not t.strip():
        return []
    if len(t) <= size:
        return [t]
    out, at, least = [], 0, max((size - overlap) // 4, 1)
    while True:
        target = min(size, len(t) - at)
        taken = target
        if at + target < len(t) and overlap:
            space = t.rfind(" ", at + target - overlap, at + target)
            if space > at and space - at >= overlap + least:
                taken = space - at
        piece = t[at : at + taken].strip()
        if piece:
            out.append(piece)
        if at + taken >= len(t):
            return out
        at += max(taken - overlap, least)


def test_fold_is_the_plain_one(spark):
    values = MESSAGES + ["ĐƯỜNG  ĐI\t\n lên ", "e\u0301 a\u0300", "ſ İ ı ß ﬁ", "한국어 日本", "\u00a0 x\u2003y \u0085", None, "Ǆ Ω ё й"]
    plain = [None if v is None else context.folded(v) for v in values]
    assert column(spark, values, text.fold) == plain


def test_fold_of_every_letter(spark):
    letters = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.category(chr(c)) in ("Lu", "Ll")]
    found = column(spark, letters, text.fold)
    wrong = [c for c, f in zip(letters, found) if f != context.folded(c)]
    assert len(wrong) < 40 and not any(ord(c) < 0x250 or 0x1EA0 <= ord(c) < 0x1F00 for c in wrong if c != "İ")


def test_clean_lines(spark):
    values = ["a\r\nb\ra\n---\n a \nA\n\\begin{x}\nLớp: 1\nLớp: 2\n\n\\[ z \\]\n1", "", None, "---", "x\nx\nx", " same \nsame\nother\nsame\nSÁME"]
    assert column(spark, values, text.clean_lines) == [context.LineCounter().clean(v or "") for v in values]


def test_line_cap_over_chunks(spark):
    from ragloom.operators.chunking import cap_lines

    rows = spark.createDataFrame([("f", 1, "x\nx\ny"), ("f", 2, "x\nx"), ("g", 1, "x"), ("f", 3, None)], "s string, o int, document string").withColumn("k", F.col("o"))
    assert sorted(map(tuple, cap_lines(rows, "s", "o", "k").collect())) == [("f", 1, "x\nx\ny"), ("f", 2, ""), ("f", 3, ""), ("g", 1, "x")]


@pytest.mark.parametrize("size, overlap", [(600, 100), (10, 4), (100, 20), (50, 0), (7, 3)])
def test_chunks_are_the_plain_ones(spark, size, overlap):
    r = random.Random(size)
    values = ["abcde " * 833, " ".join("abcdefghijklmnopqrstuvwxyz"), " " * 500 + "x" + " " * 509, "x" * 1500, "", "   ", " short ", "một hai ba " * 90]
    values += ["".join(r.choice("ab  c\n") for _ in range(r.randrange(1500))) for _ in range(25)]
    found = column(spark, values, lambda c: text.chunks(c, size, overlap))
    assert found == [plain_chunks(v, size, overlap) for v in values]


def test_chunk_numbers_of_the_known_cases(spark):
    a, b, c = column(spark, ["abcde " * 833], lambda v: text.chunks(v))[0], column(spark, [" ".join("abcdefghijklmnopqrstuvwxyz")], lambda v: text.chunks(v, 10, 4))[0], column(spark, ["a" + " " * 500 + "b" + " " * 507 + "c"], lambda v: text.chunks(v, 100, 20))[0]
    assert 8 <= len(a) <= 12 and len(b) < 50 and len(c) <= 15


@pytest.mark.parametrize("size, overlap", [(0, 100), (600, -1), (600, 301)])
def test_chunk_arguments(size, overlap):
    with pytest.raises(ValueError):
        text.chunks(F.lit("x"), size, overlap)


def test_steps(spark):
    assert column(spark, ["Bước 1: a B2: b Buoc 3: c", "BƯỚC 1: x", "step 1: x", "abc2: x", ""], text.count_steps) == [3, 1, 0, 0, 0]
    assert column(spark, ["B1: a\nB2: b\nB1: c\nB2: d", "intro. B1: a B1: b", "intro B1: a", "none", None], text.procedure_blocks) == [["B1: a\nB2: b", "B1: c\nB2: d"], ["B1: a", "B1: b"], ["intro B1: a"], [], None]
    assert column(spark, ["Bước 1", " step 12 x", "B 3:", "bo 3", "Bước"], text.is_step_line) == [True, True, True, False, False]


def test_truncation_identifier_and_name(spark):
    values = ["aaa bbb ccc", "aaaaaaaaaa", "aa bb", " aaaaaaaaa", "aaaa    bbbb", "a b c d e f", None]
    assert column(spark, values, lambda c: text.truncate_at_space(c, 8)) == [None if v is None else context.shortened(v, 8) for v in values]
    assert column(spark, ["a 123456 b", "12345", "x1234567", "id:9876543210.", None], text.identifier) == ["123456", None, None, "9876543210", None]
    names = column(spark, ["Email của Nguyễn Văn An là gì", "email cua Tran Thi Binh?", "của ai", "Hồ sơ của Lê Chi la ai", "in tài liệu của An", "Email của Trần B là gì?"], text.person_name)
    assert names == ["Nguyễn Văn An", "Tran Thi Binh", None, "Lê Chi la ai", None, "Trần B là gì"]


def test_intents(spark):
    cases = {"Cách tạo tờ trình": "TaskInstruction", "Nút duyệt ở đâu": "General", "màn hình chính": "UiLocation", "chương trình đào tạo": "General", "trường bắt buộc": "UiLocation", "đào tạo và tạo": "TaskInstruction", "hello": "General", "taoism": "General"}
    assert column(spark, list(cases), intent.query_intent) == list(cases.values())


def test_actions(spark):
    cases = {"In tờ trình": "in", "tờ trình nghiệp vụ": None, "Gửi phê duyệt": "gui_phe_duyet", "phê duyệt": "duyet", "Xem chi tiết": "tim_kiem", "thêm ghi chú": "them_ghi_chu", "Thêm": "them_moi", "inbox": None, "duyet.": None, "x (in) y": "in", "dinh kem file moi": "dinh_kem"}
    assert column(spark, list(cases), intent.action_kind) == list(cases.values())
    assert column(spark, [" Phe_Duyet ", "DUYET", " ", None, "other"], intent.canonical_action) == ["duyet", "duyet", None, None, "other"]


def test_chunk_actions(spark):
    rows = [("x", "phe_duyet", None, "duyet"), ("in tờ trình", None, None, "in"), ("tờ trình nghiệp vụ", None, None, "in"), ("x", None, "Từ chối", "duyet"), ("a\nb\nc\nduyệt", None, None, "duyet"), ("tìm kiếm rồi duyệt", None, None, "duyet"), (None, None, None, "duyet"), ("x", "luu_nhap", "Duyệt", "duyet")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, k string, s string, w string")
    c = [F.col(x) for x in "tksw"]
    found = [tuple(r)[1:] for r in sorted(df.select("i", intent.chunk_matches(*c), intent.chunk_differs(*c)).collect())]
    assert found == [(True, False), (True, False), (False, False), (False, True), (False, False), (True, True), (False, False), (False, True)]


def test_policies(spark):
    assert column(spark, ["20110123?", "mssv", "in bảng", "cách làm", "xin hỏi", "diploma id"], intent.top_k) == [50, 50, 20, 20, 3, 50]  # "ma id" counts anywhere
    assert column(spark, ["x", "B1: a", "B1: a " * 4, "B1: a " * 30], intent.answer_tokens) == [600, 900, 1080, 1800]
    assert column(spark, ["Xin chào", "chào bạn", None], intent.is_greeting) == [True, False, False]


def test_records(spark):
    found = column(spark, RECORDS, structured.fields)
    assert [(f.key, f.value) for f in found[2]] == [("mssv", "20110125"), ("name", '"Lê, Minh Châu"'), ("mail", "chau@example.com"), ("class", "KT1")]
    assert [(f.key, f.value) for f in found[5]] == [("c", "d")] and found[4] == [] and [(f.key, f.value) for f in found[6]] == [("x", '"1, 2, y: 3, z: 4')]
    who = column(spark, RECORDS, structured.person)
    assert who[1].full_name == "Trần Thị Bình" and who[3].student_id == "20110126" and who[8].email == "hoa@example.com"


def test_answers(spark):
    questions = ["20110123 là của ai?", "Email của Nguyễn Văn An", "email của Lê Minh", "99999999 là ai", "Xin chào", "Email của Phạm Dung?"]
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, q string")
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "k int, r string")
    met = asked.crossJoin(rows).select("i", "k", structured.answer_from(F.col("q"), structured.person(F.col("r"))).alias("a")).filter("a is not null").collect()
    first = {}
    for r in sorted(met):
        first.setdefault(r.i, r.a)
    assert first == {0: "Mã số ID: 20110123, Họ tên: Nguyễn Văn An, Email: an.nguyen@example.com, Lớp: CNTT1.", 1: "Email của Nguyễn Văn An là an.nguyen@example.com.", 5: structured.NO_MAIL}
    assert column(spark, questions, structured.asks_for_record) == [True, True, True, True, False, True]


def test_captions(spark):
    good = "This screen has a table with a button and a field for the search of records by date"
    values = [good, good + " 日", good + "?????", "button", None, " ".join(["button"] * 30), good + " <visible title", "a nice view of something that has no use at all here", good + "\n" + "0" * 200, good + " " + "1234567." * 45, good + " " + "98765,4321" * 3000, "\n".join(["the same line of button text"] * 3 + ["another line of text"])]
    assert column(spark, values, generated.caption_is_useful) == [True] + [False] * 11


def test_repetition(spark):
    tail = "this is a tail of forty characters, yes "
    values = ["x" * 10, "start of the text " * 2 + tail + "and then " * 5 + tail.strip() + " ok " + tail, "one line\n" * 3 + "z" * 100, "\n".join(f"Bước {i}: làm việc số {i} khác nhau hoàn toàn" for i in range(5)), None]
    assert column(spark, values, generated.is_repetition_loop) == [False, True, True, False, False]
    sentence = "This sentence has more than thirty-five characters. "
    assert column(spark, [sentence * 4, sentence * 2, (sentence + "Another sentence that is quite a bit longer, too. ") * 2 + sentence], generated.repeats_last_sentence) == [True, False, True]


def test_images(spark):
    df = spark.createDataFrame([(10, 10, None), (10, 10, "OK"), (10, 10, "x" * 60), (800, 600, ""), (800, 600, "x" * 60)], "w int, h int, o string")
    role = generated.image_role(F.col("w"), F.col("h"), F.col("o"), 160, 90)
    assert [r[0] for r in df.select(role).collect()] == ["InlineIcon", "InlineIcon", "UnknownImage", "UiScreenshot", "UiScreenshot"]
    sizes = spark.createDataFrame([(2, 36), (10, 100), (80, 40), (20, 400)], "w int, h int")
    assert [r[0] for r in sizes.select(generated.skip_recognition(F.col("w"), F.col("h"))).collect()] == [True, True, False, True]


def test_chunks_of_a_long_text_take_seconds(spark):
    import random
    import time

    r = random.Random(3)
    long_ = " ".join("𝕏é" * r.randrange(5) + "w" * r.randrange(9) for _ in range(260_000))
    began = time.perf_counter()
    made = spark.createDataFrame([(long_,)], "t string").select(F.explode(text.chunks(F.col("t"))).alias("c")).collect()
    assert time.perf_counter() - began < 30 and len(long_) > 1_900_000
    white = "\t\n\x0b\x0c\r \x85\xa0"
    expected, at = [], 0
    while True:  # one window after the other
        target = min(600, len(long_) - at)
        back = long_[at + target - 100 : at + target][::-1].find(" ") + 1
        taken = target - back if at + target < len(long_) and back and target - back >= 225 else target
        expected += [long_[at : at + taken].strip(white)] if long_[at : at + taken].strip(white) else []
        if at + taken >= len(long_):
            break
        at += max(taken - 100, 125)
    assert [x.c for x in made] == expected


def test_plain_helpers_agree_with_columns(spark):
    from ragloom.operators.context import folded
    from ragloom.sources import files

    r = random.Random(11)
    words = ["Bước 1:", "bước 2 :", "BUOC 3:", "B1:", "B 1 :", "Step 4", "phê duyệt", "in", "In tờ trình", "tạo mới", "đính kèm", "Từ chối", "ủy quyền", "\n", "x", "Ⅻ", "ß", "É", "١:", "b١:", "inbox"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(9))) for _ in range(400)] + MESSAGES
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.fold(t).alias("f"), text.count_steps(t).alias("n"), text.is_step_line(t).alias("s"), text.procedure_blocks(t).alias("b"), intent.action_kind(t).alias("a")).collect()
    for row in rows:
        assert (row.f, row.n, row.a) == (folded(row.t), len(files._STEPS.findall(row.t)), files.action_of(row.t)), row.t
        assert row.s == bool(files._STEP_LINE.search(row.t)) and row.b == files.procedure_blocks(row.t), row.t

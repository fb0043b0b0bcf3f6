"""Predicates on generated and recognised text: captions, endless repetition, roles of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled_lines, fold, is_blank, once, trim_space

# What captions must and must not contain.
PLACEHOLDERS = ["<visible title", "<visible text", "<verbatim important", "<table names", "<button names", "<only if useful", "<ghi ", "<chep ", "<liet ke ", "<chi ghi "]
EVIDENCE = [
    "image_type", "system_or_app_name", "screen_or_document_title", "visible_text", "ui_panels", "search_conditions", "data_tables", "email_info", "buttons_or_actions", "counts", "question_answer_hints", "searchable_summary",
    "dieu kien", "tim kiem", "to trinh", "so to", "trang thai", "ngay", "tu ngay", "den ngay",
    "nut", "bang", "cot", "dong", "o nhap", "checkbox", "combobox", "button", "field", "table", "panel", "textbox", "dropdown", "date-picker", "email", "from", "subject", "attachment",
]
NUMBER_RUN, ZERO_RUN = r"\d(?:[.,]*+\d){79}", r"(?:0{8,}|0001|0002|\.000){8,}"


def _most_equal(values: Column) -> Column:
    """How often the commonest of ``values`` occurs; 0 without values."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(F.array_sort(values), start, step, lambda acc: acc["most"])


def _contains(text: Column, values: list[str]) -> Column:
    return text.rlike("|".join(values))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def caption_is_useful(caption: Column) -> Column:
    """Whether a caption says something of the picture; never null."""
    text = F.coalesce(caption, F.lit(""))
    folded = fold(text)
    long_lines = F.filter(F.transform(filled_lines(text), fold), lambda line: F.length(line) > 12)
    repeated = once(long_lines, lambda found: (F.size(found) >= 4) & (_most_equal(found) >= 3))

    def too_common(tokens: Column) -> Column:
        return once(_most_equal(tokens), lambda most: (F.size(tokens) >= 20) & ((most >= 12) | (most >= F.size(tokens) * F.lit(0.45).cast("double"))))

    degenerate = once(F.filter(F.split(folded, " "), lambda t: t != ""), too_common)
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    digits, letters = _count(compact, r"\p{Nd}"), _count(text, r"\p{L}")
    runaway = (F.length(compact) >= 120) & (((digits > letters * 3) & compact.rlike(NUMBER_RUN)) | compact.rlike(ZERO_RUN))
    odd = (_count(text, r"\?") >= 5) | text.rlike("[一-鿿]") | _contains(folded, PLACEHOLDERS)
    return ~is_blank(text) & (F.length(folded) >= 40) & ~odd & ~repeated & ~degenerate & ~runaway & _contains(folded, EVIDENCE) & (letters >= 20)


def repeats_lines(text: Column) -> Column:
    """A folded line occurs three times or more."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]"), fold), lambda line: line != "")
    return _most_equal(found) >= 3


def repeats_last_sentence(text: Column) -> Column:
    """Of four or more sentences of 35 folded characters at least, the last one occurs three times or more."""
    found = F.filter(F.transform(F.split(trim_space(F.coalesce(text, F.lit(""))), r"(?U)(?<=[.!?])\s+"), fold), lambda s: F.length(s) >= 35)

    def again(all_: Column) -> Column:
        return (F.size(all_) >= 4) & (F.size(F.filter(all_, lambda s: s == F.try_element_at(all_, F.lit(-1)))) >= 3)

    return once(found, again)


def repeats_tail(text: Column, length: int = 40) -> Column:
    """The last ``length`` folded characters occur twice without overlap, scanned from the left."""

    def again(folded: Column) -> Column:
        tail = F.right(folded, F.lit(length))
        return (F.length(folded) >= 2 * length) & (F.position(tail, folded, F.position(tail, folded) + length) > 0)

    return once(fold(F.coalesce(text, F.lit(""))), again)


def is_repetition_loop(text: Column) -> Column:
    """Text of 100 characters or more that repeats its last sentence, its tail or a line; never null."""
    return F.coalesce((F.length(text) >= 100) & (repeats_last_sentence(text) | repeats_tail(text) | repeats_lines(text)), F.lit(False))


ICON, SCREENSHOT, UNKNOWN = "InlineIcon", "UiScreenshot", "UnknownImage"


def image_role(width: Column, height: Column, ocr: Column, least_width: int, least_height: int, floating: Column | None = None) -> Column:
    """Small images without text, or with up to 50 characters of it, are icons; large and floating ones are screenshots."""
    small = (width < least_width) | (height < least_height)
    role = F.when(small & (is_blank(ocr) | (F.length(ocr) <= 50)), ICON).when(~small, SCREENSHOT).otherwise(UNKNOWN)
    return role if floating is None else F.when(floating, SCREENSHOT).otherwise(role)


def inline_marker(ocr: Column) -> Column:
    """The mark of an icon in a text, or null for an icon without text."""
    return F.when(~is_blank(ocr), F.concat(F.lit("[Nút/Ảnh: "), trim_space(ocr), F.lit("]")))


SCREENSHOT_MARK = "[Ảnh giao diện]"


def skip_recognition(width: Column, height: Column) -> Column:
    """Images with a side under 20 pixels or sides that differ by more than 15 times are not read."""
    narrow, wide = F.least(width, height), F.greatest(width, height)
    return (narrow < 20) | (narrow * 15 < wide)

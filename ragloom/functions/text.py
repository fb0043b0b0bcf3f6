"""Text functions as Column expressions; all stay in the JVM.

Null texts give null unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed a single time however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters that have a base letter in the Basic Multilingual Plane, after lower-casing, and these base letters."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or unicodedata.category(c) == "Mn":
            continue
        plain = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if plain != c and len(plain) == 1:
            source.append(c)
            target.append(plain)
    return "".join(source) + "đ", "".join(target) + "d"


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Null or nothing but white space; never null."""
    return F.coalesce(trim_space(text) == "", F.lit(True))


def plain(text: Column) -> Column:
    """Lower case, no accents, đ as d."""
    return F.regexp_replace(F.translate(F.lower(text), *_fold_table()), r"\p{Mn}", "")


def fold(text: Column) -> Column:
    """Lower case, no accents, đ as d, white space collapsed and trimmed."""
    return trim_space(F.regexp_replace(plain(text), r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """Parts between CRLF, CR or LF."""
    return F.split(text, r"\r\n|\r|\n")


def filled_lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(lines(text), trim_space), lambda line: line != "")


def useful_line(line: Column) -> Column:
    """A trimmed line that is neither blank, nor TeX markup, nor without letters and digits."""
    markup = line.contains("\\begin") | line.contains("\\end") | line.contains("\\[") | line.contains("\\]")
    return (line != "") & ~markup & line.rlike(r"[\p{L}\p{Nd}]")


def clean_lines(text: Column, repeats: int = 2) -> Column:
    """Useful lines joined by LF, each at most ``repeats`` times by its folded form. Null gives an empty text."""
    kept = F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), trim_space), useful_line)
    keyed = F.array_sort(F.transform(kept, lambda line, i: F.struct(fold(line).alias("key"), i.alias("at"), line.alias("line"))))
    # in the order of the folded lines, a line is one too many if the line ``repeats`` places before it is equal
    chosen = once(keyed, lambda s: F.filter(s, lambda x, i: (i < repeats) | (F.get(s, i - repeats)["key"] != x["key"])))
    return F.array_join(F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line")))), lambda x: x["line"]), "\n")


def truncate_at_space(text: Column, most: int | Column) -> Column:
    """At most ``most`` characters, cut at the last space if there is one, without white space at the end."""
    most = F.lit(most) if isinstance(most, int) else most
    head = F.substring(text, F.lit(1), most)
    last = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when((F.instr(head, " ") > 0) & (last > 0), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(cut, r"(?U)\s+$", ""))


#: How a step is written. Case is ignored for letters with accents too.
STEP = r"(?iU)\b(?:Bước|Buoc|B)\s*\d+\s*:"
FIRST_STEP = r"(?iU)\b(?:Bước|Buoc|B)\s*1\s*:"
STEP_LINE = r"(?iU)^\s*(?:Bước|Buoc|Step|B)\s*\d+\b"
IDENTIFIER = r"(?U)\b\d{6,}\b"


def count_steps(text: Column) -> Column:
    return F.regexp_count(text, F.lit(STEP))


def is_step_line(line: Column) -> Column:
    return line.rlike(STEP_LINE)


def procedure_blocks(text: Column) -> Column:
    """Blocks of steps. Without steps none; with several first steps one from each, and what stands before is left out."""
    starts = F.regexp_count(text, F.lit(FIRST_STEP))
    parts = F.filter(F.transform(F.split(text, "(?=" + FIRST_STEP + ")"), trim_space), lambda p: p != "")
    begins = F.filter(parts, lambda p: p.rlike("(?U)^" + FIRST_STEP))
    none = F.array().cast("array<string>")
    return F.when(count_steps(text) == 0, none).when(starts <= 1, F.array(trim_space(text))).otherwise(begins)


def identifier(text: Column) -> Column:
    """The first whole number of six digits or more, else null."""
    return F.nullif(F.regexp_extract(text, IDENTIFIER, 0), F.lit(""))


def person_name(text: Column) -> Column:
    """The name after "email of" or "of" in a question about an e-mail address or a person, else null.

    The question may end in "is what" or a question mark, but only one of these is left out.
    """
    asked = fold(text).rlike("email|mail|thu dien tu|cua ai|la ai")
    tail = r"\s+(.+?)(?:\s+(?:là|la)\s+gì|[?？])?$"
    mail = F.regexp_extract(text, r"(?iu)(?:email|mail|thư điện tử)\s+(?:của|cua)" + tail, 1)
    anyone = trim_space(F.regexp_extract(text, r"(?iu)(?:của|cua)" + tail, 1))
    other = F.when((anyone != "") & ~fold(anyone).isin("ai", "ai vay"), anyone)
    return F.when(asked, F.when(mail != "", trim_space(mail)).otherwise(other))


def chunk_id(path: Column, modified: Column, length: Column, index: Column) -> Column:
    """SHA-256 of path, modification time in 100 ns ticks since year 1, and length; then the chunk's number."""
    ticks = F.lit(621355968000000000).cast("long") + F.unix_micros(modified) * 10
    return F.concat(F.sha2(F.concat_ws("|", path, ticks.cast("string"), length.cast("string")), 256), F.lit("_chunk_"), index.cast("string"))


def cache_key(text: Column) -> Column:
    """Trimmed, in lower case, white space collapsed; accents stay."""
    return trim_space(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


#: Chunks that are found before their list is put to the others: lists of lists grow by fewer copies.
GROUP = 64


def chunks(text: Column, size: int = 600, overlap: int = 100) -> Column:
    """Overlapping chunks of ``text``, cut at spaces where one is near the end of the window.

    A text of at most ``size`` characters is one chunk as it is; else chunks are trimmed and blank ones left out. A blank text
    has none. A cut advances by a quarter of ``size - overlap`` at least. The text is cut into blocks of ``size`` once, and a window looks at two of
    them, so a long text takes as much time for each chunk as a short one.
    """
    if size <= 0 or overlap < 0 or overlap > size // 2:
        raise ValueError(f"size {size} and overlap {overlap} do not fit")
    least = max((size - overlap) // 4, 1)
    none = F.array().cast("array<string>")

    def walked(cut: Column) -> Column:
        blocks, n = cut["blocks"], cut["n"]  # counted once: a length is a walk through the text

        def part(at: Column, length: Column) -> Column:  # at most ``size`` characters
            k = F.floor(at / size).cast("int")
            return F.substring(F.concat(F.get(blocks, k), F.coalesce(F.get(blocks, k + 1), F.lit(""))), at % size + 1, length)

        def step(acc: Column, _: Column) -> Column:
            at = acc["at"]
            target = F.least(F.lit(size), n - at)

            def length(window: Column) -> Column:
                back = F.instr(F.reverse(F.right(window, F.lit(overlap))), " ") if overlap else F.lit(0)  # place of the last space, counted from the window's end
                return once(back, lambda b: F.when((at + target < n) & (b > 0) & (target - b > 0) & (target - b >= overlap + least), target - b).otherwise(target))

            def moved(window: Column) -> Column:
                def taken(t: Column) -> Column:
                    piece = F.filter(F.array(trim_space(F.substring(window, F.lit(1), t))), lambda p: p != "")
                    return F.struct((at + F.greatest(t - overlap, F.lit(least))).alias("at"), (at + t >= n).alias("done"), F.concat(acc["out"], piece).alias("out"))

                return once(length(window), taken)

            return F.when(acc["done"], acc).otherwise(once(part(at, target), moved))

        def group(acc: Column, _: Column) -> Column:
            fresh = F.struct(acc["at"].alias("at"), acc["done"].alias("done"), none.alias("out"))
            some = F.aggregate(F.sequence(F.lit(1), F.lit(GROUP)), fresh, step)
            return F.when(acc["done"], acc).otherwise(once(some, lambda g: F.struct(g["at"].alias("at"), g["done"].alias("done"), F.concat(acc["out"], F.array(g["out"])).alias("out"))))

        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<array<string>>").alias("out"))
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / (least * GROUP)).cast("int")))
        return F.aggregate(rounds, start, group, lambda acc: F.flatten(acc["out"]))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    whole = F.struct(blocks.alias("blocks"), F.length(text).alias("n"))
    return F.when(is_blank(text), none).when(F.length(text) <= size, F.array(text)).otherwise(once(whole, walked))

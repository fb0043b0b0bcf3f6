"""License scans by ordered signature rules, in DataFrame operations only.

Texts become words in lower case. Of a text that holds one of a few stems, blocks of words are searched: the rules whose keyword a block
holds are matched there, and each match is a detection with its place in words. Detections of several rules overlap: one that lies
inside another of the same or a stronger tier is suppressed, however many there are, in time that grows with their number.
All happens in a row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import MOST_WORDS, RULES, STEMS, WEIGHTS

#: Words in whose range a block's matches start; a match may end up to :data:`MOST_WORDS` later.
BLOCK_WORDS = 1000
#: Detections that are compared one with the other; between such chunks maxima are carried.
CHUNK = 128
#: Phrases that are always found, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PATTERN = " (?:" + "|".join(BASE) + ")(?= )"
_DETECTION = "array<struct<start:bigint,stop:bigint,tier:int,rule:int,label:string,weight:double>>"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL in which ``value`` is computed once and called ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def spaces(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def normal_text(text: Column) -> Column:
    """The words of a text in lower case (A-Z only) with one space between; null is empty. Letters and digits of ASCII and all else beyond it make words."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NO_WORD, " "))


def _rule_table() -> str:
    rows = (f"named_struct('rule', {r.number}, 'label', {quoted(r.label)}, 'keyword', {quoted(r.keyword)}, 'tier', {r.tier}, 'weight', {WEIGHTS[r.tier]}D, 'pattern', {quoted(r.pattern)})" for r in RULES)
    return f"array({', '.join(rows)})"


def found_in_words(words: str, block_words: int = BLOCK_WORDS) -> str:
    """SQL of all detections in a text of words, sorted by start, longest first, tier and rule; ``stop`` is the word after the last."""
    # Every word stands between two spaces of its own, so matches that follow each other share none.
    block = f"concat(' ', array_join(slice(w, at + 1, {block_words + MOST_WORDS}), '  '), ' ')"
    before = "concat(array_join(slice(z.p, 1, k + 1), ''), array_join(slice(z.m, 1, k), ''))"
    own = f"named_struct('start', at + {let('b', before, spaces('b'))} div 2, 'stop', at + ({let('b', before, spaces('b'))} + {spaces('m')}) div 2, 'tier', r.tier, 'rule', r.rule, 'label', r.label, 'weight', r.weight)"
    matches = let("z", "named_struct('p', split(t, r.pattern), 'm', regexp_extract_all(t, r.pattern, 0))", f"filter(transform(z.m, (m, k) -> {own}), d -> d.start < at + {block_words})")
    of_block = let("t", block, f"flatten(transform(filter(rules, r -> contains(t, r.keyword)), r -> {matches}))")
    all_blocks = let("w", f"split({words}, ' ')", let("rules", _rule_table(), f"flatten(transform(sequence(0L, size(w) - 1L, {block_words}L), at -> {of_block}))"))
    ordered = "CASE WHEN x.start <> y.start THEN sign(x.start - y.start) WHEN x.stop <> y.stop THEN sign(y.stop - x.stop) WHEN x.tier <> y.tier THEN sign(x.tier - y.tier) ELSE sign(x.rule - y.rule) END"
    return f"array_sort({all_blocks}, (x, y) -> CAST({ordered} AS INT))"


def kept_detections(sorted_: str, chunk: int = CHUNK) -> str:
    """SQL of those of sorted detections that lie in no other one of the same or a stronger tier; of equal ones the first stays."""
    tiers = f"sequence(1, {max(WEIGHTS)})"
    chunks = f"transform(sequence(0, (size(s) - 1) div {chunk}), c -> slice(s, c * {chunk} + 1, {chunk}))"
    tops = f"transform(parts, part -> transform({tiers}, t -> array_max(transform(part, d -> IF(d.tier <= t, d.stop, 0L)))))"
    carried = f"transform(sequence(0, size(tops) - 1), c -> transform({tiers}, t -> coalesce(array_max(transform(slice(tops, 1, c), m -> m[t - 1])), 0L)))"
    within = "filter(z.part, (d, j) -> z.most[d.tier - 1] < d.stop AND NOT exists(slice(z.part, 1, j), e -> e.tier <= d.tier AND e.stop >= d.stop))"
    whole = let("parts", chunks, let("tops", tops, f"flatten(transform(arrays_zip(parts, {carried}), y -> {let('z', "named_struct('part', y.parts, 'most', y.`1`)", within)}))"))
    return let("s", sorted_, f"CASE WHEN size(s) = 0 THEN s ELSE {whole} END")


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS, chunk: int = CHUNK) -> DataFrame:
    """``row, out`` for each row of ``docs``: ``row`` is a struct of the columns ``keep`` (all but the text by default), so names never clash.

    ``out`` has ``n_words``, the base phrases' places ``n_base, first_word, last_word`` (words from 0, null if there are none) and ``base_labels`` (sorted), the kept
    ``detections`` (start and stop in words, tier, rule, label, weight; by start), ``labels`` (base labels and those of kept detections, sorted) and ``score``, the
    greatest weight of a kept detection or 0. Matches of one rule do not overlap within a block of words. A null text is empty and has no words and no labels.
    Repeated rows are scanned one by one; an empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col]
    present = "_present"
    while present in keep:
        present += "_"
    row = F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(True).alias(present)).alias("row")
    normal = docs.select(row, normal_text(F.col(f"`{text_col}`")).alias("words"))
    # cheap tests are a column of their own, so that what follows is computed for texts with a stem only
    any_stem = F.lit(False)
    for stem in STEMS:
        any_stem = any_stem | F.contains("words", F.lit(stem))
    padded = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    n_words = F.expr(f"CASE WHEN words = '' THEN 0L ELSE CAST({spaces('words')} + 1 AS BIGINT) END")
    bases = F.when(any_stem, F.regexp_extract_all(padded, F.lit(BASE_PATTERN), F.lit(0)))
    rest = F.when(any_stem, F.split(padded, BASE_PATTERN))
    found = F.when(any_stem, F.expr(kept_detections(found_in_words("words", block_words), chunk)))
    none = F.lit(None).cast("array<string>")
    parts = normal.select("row", n_words.alias("n_words"), F.coalesce(bases, none).alias("bases"), F.coalesce(rest, none).alias("rest"), F.coalesce(found, F.array().cast(_DETECTION)).alias("found"))
    n_base = F.greatest(F.size("bases"), F.lit(0)).cast("long")
    named = F.array_sort(F.array_distinct(F.transform(F.coalesce("bases", F.array().cast("array<string>")), lambda m: F.create_map(*(x for p, label in BASE.items() for x in (F.lit(f" {p}"), F.lit(label))))[m])))
    out = F.struct(
        F.col("n_words"),
        n_base.alias("n_base"),
        F.expr(f"CASE WHEN size(bases) > 0 THEN CAST({spaces('rest[0]')} AS BIGINT) END").alias("first_word"),
        F.expr(f"CASE WHEN size(bases) > 0 THEN CAST(n_words - ({spaces('rest[size(rest) - 1]')} - 1) - {spaces('bases[size(bases) - 1]')} AS BIGINT) END").alias("last_word"),
        named.alias("base_labels"),
        F.col("found").alias("detections"),
        F.array_sort(F.array_distinct(F.concat(named, F.transform("found", lambda d: d["label"])))).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
    return parts.select("row", out.alias("out"))

"""Quality rules: base counts, and bands of n-gram perplexity for each language.

The language model is that of :mod:`ngram_model`: whole code points, counted over all documents, a model for each
half of a language's documents. A document is scored by the half that it is not in, so its own n-grams
do not count as seen. A language's documents form a distribution of log perplexity; a document outside the
language's band, on either side, is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_model
from .common import computing, forget, join_few, source_rows, tidied, written

#: N-gram values that a scoring task holds at once, 16 bytes each; more are joined with chunks of documents.
VALUES_PER_TASK = 6 << 20
#: Half widths of the bands below and above the median. The unit is the spread of a document's length:
#: the distance between the median and the 16th (84th) percentile, and the chance variation of n symbols.
LOW_WIDTH, HIGH_WIDTH = 2.5, 2.5
#: Distances below this (in nats) count as this, so that uniform languages keep wide bands.
LEAST_DISTANCE = 0.02
#: Log perplexities (in nats) are counted by steps of this for the bands.
BAND_STEP = 1e-4
#: Variance of a symbol's log probability, for the chance variation.
SYMBOL_VARIANCE = 1.0
WINDOW = 8
BASE_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


_SPACE = bytes(range(9, 14)) + b" "
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    mixed ^= mixed >> np.uint64(29)
    count = n - window + 1
    sums = np.zeros(count, np.uint64)
    for k in range(window):
        sums += mixed[k : k + count] * _MIX[k % len(_MIX)] * np.uint64(2 * (k // len(_MIX)) + 1)
    if len(np.unique(sums)) == count:  # equal windows have equal sums
        return 0
    rank, width = ids, 1
    while width < window:  # exact ranks of windows, each from two that overlap or touch
        step = min(width, window - width)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width += step
    twice = np.bincount(rank)[rank] > 1
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.flatnonzero(twice), 1)
    np.add.at(marks, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(marks)[:n] > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_CHARS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def score(docs: DataFrame, values: DataFrame, keep: list[str], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows ``row, text, out`` of ``docs``: the base counts, ``lang_id``, ``n_chars`` and ``log_perplexity`` (null without text).

    ``values`` is a table of :func:`ngram_model.values`. Either way of finding them gives the same rows.
    """
    fields = BASE_FIELDS + ", lang_id long, n_chars long, log_perplexity double"
    source, schema = source_rows(docs, text_col, keep, fields, (ngram_model.language(F.col(f"`{lang_col}`")),))
    names = schema["out"].dataType.names

    def compute(find):
        def of(texts: list[bytes], ids: list[int]) -> list[pa.Array]:
            base = list(zip(*map(base_counts, texts))) or [()] * 5
            logs, sizes = ngram_model.log_perplexity(texts, ids, find)
            return [*(pa.array(c, pa.int64()) for c in base), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(logs, pa.float64())]

        return computing(of, text_col in keep, names, 1)

    if values.count() <= VALUES_PER_TASK:
        model = ngram_model.Model(values._ragloom_path)
        return source.mapInArrow(tidied(compute(model.find), release=model.release), schema)

    def together(rows: pa.Table, find) -> pa.Table:
        batches = rows.select(["row", "text", "m"]).combine_chunks().to_batches(max_chunksize=4096)
        return pa.Table.from_batches(list(compute(find)(iter(batches))))

    return ngram_model.by_join(source.withColumnRenamed("_0", "m"), values, together, schema)


def bands(scored: DataFrame) -> DataFrame:
    """``lang_id, middle, below, above``: median log perplexity of each language and its distances, from all its documents.

    Documents are counted by steps of :data:`BAND_STEP` first. So a language is few rows, however large it is, and its band is
    the same whatever the partitions and the order in which tasks end.
    """
    step = F.round(F.col("log_perplexity") / BAND_STEP).cast("long").alias("step")
    counted = scored.filter("log_perplexity is not null").groupBy("lang_id", step).count()
    p = F.transform(F.percentile("step", F.array(*map(F.lit, (0.16, 0.5, 0.84))), F.col("count")), lambda x: x * BAND_STEP)
    of = counted.groupBy("lang_id").agg(p.alias("p"))
    least = F.lit(LEAST_DISTANCE)
    return of.select("lang_id", F.col("p")[1].alias("middle"), F.greatest(least, F.col("p")[1] - F.col("p")[0]).alias("below"), F.greatest(least, F.col("p")[2] - F.col("p")[1]).alias("above"))


def base_failed() -> Column:
    return (F.col("out.n_words") < 20) | (100 * F.col("out.n_repeat_words") > 30 * F.col("out.n_words"))


def judge(docs: DataFrame, keep: list[str] | None = None, lang_col: str = "lang", text_col: str = "text", low_width: float = LOW_WIDTH, high_width: float = HIGH_WIDTH) -> DataFrame:
    """Rows ``row, text, out, base_failed, kept, perplexity, low, high`` for each row of ``docs``.

    ``low`` and ``high`` are the perplexities between which a document of this language and length stays.
    Null and empty texts have no words and fail the base rules. Each distinct language has its own model and band; a null
    language is the empty one. Repeated rows are judged alike and all come back. Texts of any length are judged whole; an empty table gives
    an empty result; ids and other columns play no part, whatever their names. Counts, model and bands come from all rows of ``docs``.
    """
    counts = ngram_model.count(docs, ngram_model.language(F.col(f"`{lang_col}`")), F.col(f"`{text_col}`"))
    values = ngram_model.values(ngram_model.train(written(counts, "ngram-counts")))
    scored = written(score(docs, values, docs.columns if keep is None else keep, lang_col, text_col), "quality-scores")
    forget(values)
    limits = written(bands(scored.select("out.*")), "bands")
    chance = F.lit(SYMBOL_VARIANCE) / F.nullif(F.col("out.n_chars"), F.lit(0))
    low = F.col("middle") - low_width * F.sqrt(F.col("below") * F.col("below") + chance)
    high = F.col("middle") + high_width * F.sqrt(F.col("above") * F.col("above") + chance)
    return (
        join_few(scored.withColumn("lang_id", F.col("out.lang_id")), limits, "lang_id", "out", how="left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("out.log_perplexity").between(low, high), F.lit(False)))
        .select("row", "text", "out", "base_failed", "kept", F.exp("out.log_perplexity").alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"))
    )

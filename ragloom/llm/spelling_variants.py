"""Spelling variants: words one edit apart, found by dense tiles of padded code-point matrices.

Two words are near if one inserted, deleted or replaced code point turns one into the other: then the lengths of their common
prefix and common suffix add up to at least the longer length less one. Blocks of words are compared with blocks of words, all
pairs of a tile at once, one matrix column after the other.

Only words that can be near meet. An edit lies in one segment of the longer word, and outside it both words are equal, so words are
dealt by their length and what is left without the segment: halves first. Groups above :data:`GROUP_WORDS` are dealt again
by halves of their segment, down to one code point, so no frequent beginning or ending gathers the vocabulary in one task.
A pair belongs to the segment that holds the end of its common prefix, so it is met once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, slices, tidied, written

#: Words of a group up to which it is compared as it is; larger ones are dealt by half as long segments.
GROUP_WORDS = 4096
#: Rows and columns of a tile.
TILE = 128
#: Words that a counting task holds before it passes their counts on.
HELD_WORDS = 1 << 18
RUN = "[a-zÀ-ÿ]{%d,}"
_GROUP = ["longer", "a", "b", "h"]


def slipped(run: str, start: int, every: int) -> str:
    """``run`` without one code point if ``every`` divides its checksum, continued from ``start``."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counting(least_chars: int, slip_every: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    # a run that is too short before a code point is taken out is too short after it as well
    runs = re.compile(RUN % least_chars)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for of, text in zip(batch.column(0).to_pylist(), texts):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if of is None else of}:".encode())
                for part in slices(text.as_py().lower().decode("utf-8", "replace")):  # lower() of bytes changes A-Z alone
                    for run, n in Counter(runs.findall(part)).items():
                        if slip_every:
                            run = slipped(run, start, slip_every)
                            if len(run) < least_chars:
                                continue
                        held[run] += n
                    if len(held) > HELD_WORDS:
                        yield passed_on()
        yield passed_on()

    return each


def count_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = 6, least_n: int = 5, slip_every: int | None = None) -> DataFrame:
    """``word, n``: runs of letters of all whole texts in lower case (A-Z only), of ``least_chars`` code points and ``least_n`` occurrences at least.

    Letters are A-Z, a-z and U+00C0 to U+00FF. With ``slip_every``, slips are planted: a run of which ``crc32("<id>:<run>")`` is divisible by it loses
    the code point at that checksum modulo its length. Null and empty texts have no words, a null id stands as the
    empty text, each of repeated rows counts, an empty table gives no rows, other columns are not read.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = source.mapInArrow(tidied(_counting(least_chars, slip_every)), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _rest(longer: str, a: str, b: str) -> str:
    """SQL of a group's hash: what is left of ``word`` without code points ``a`` to ``b`` of the longer word."""
    return f"xxhash64(substring(word, 1, {a}), substring(word, {b} - {longer} + size + 1, size))"


def _halves(words: DataFrame) -> DataFrame:
    """Each word by both halves, as the longer word of a pair and as the shorter one."""
    either = words.withColumn("size", F.length("word")).withColumn("longer", F.explode(F.expr("array(size, size + 1)")))
    cut = either.withColumn("s", F.explode(F.expr("array(named_struct('a', 0, 'b', longer div 2), named_struct('a', longer div 2, 'b', longer))")))
    return cut.select("word", "n", "size", "longer", F.col("s.a").alias("a"), F.col("s.b").alias("b")).withColumn("h", F.expr(_rest("longer", "a", "b")))


def _finer(rows: DataFrame) -> DataFrame:
    """The same by halves of their segments."""
    cut = rows.drop("h").withColumn("m", F.expr("a + (b - a) div 2")).withColumn("s", F.explode(F.expr("array(named_struct('a', a, 'b', m), named_struct('a', m, 'b', b))")))
    return cut.select("word", "n", "size", "longer", F.col("s.a").alias("a"), F.col("s.b").alias("b")).withColumn("h", F.expr(_rest("longer", "a", "b")))


def _columns(words: list[str]) -> np.ndarray:
    """A matrix with a row for each place and a column for each word, padded with zeros."""
    wide = np.array(words)
    codes = wide.view(np.uint32).reshape(len(words), -1)
    return np.ascontiguousarray(codes.T.astype(np.uint8 if codes.max(initial=0) < 256 else np.uint32))


def common_lengths(left: np.ndarray, right: np.ndarray, met: np.ndarray) -> np.ndarray:
    """How many first places are equal, for each pair of a column of ``left`` and one of ``right`` that is ``met``."""
    equal, length = met.copy(), np.zeros(met.shape, np.int32)
    for x, y in zip(left, right):
        equal &= x[:, None] == y[None, :]
        if not equal.any():
            break
        length += equal
    return length


class _Block:
    def __init__(self, words: list[str], group: np.ndarray, size: np.ndarray, longer: np.ndarray, a: np.ndarray, b: np.ndarray, at: int):
        self.forward, self.backward = _columns(words), _columns([w[::-1] for w in words])
        self.group, self.size, self.longer, self.a, self.b, self.at = group, size, longer, a, b, at


def _tile(p: _Block, q: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words, one of block ``p`` and a later one of ``q``."""
    longer = p.longer[:, None]
    met = (p.group[:, None] == q.group[None, :]) & (np.maximum(p.size[:, None], q.size[None, :]) == longer)
    if p.at == q.at:
        met &= np.tri(len(p.size), k=-1, dtype=bool).T
    if not met.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = common_lengths(p.forward, q.forward, met)
    edit = np.minimum(prefix, longer - 1)
    met &= (edit >= p.a[:, None]) & (edit < p.b[:, None])  # else another segment's
    met &= prefix + common_lengths(p.backward, q.backward, met) >= longer - 1
    i, j = np.nonzero(met)
    return i + p.at, j + q.at


def near_in_groups(words: list[str], n: np.ndarray, group: np.ndarray, size: np.ndarray, longer: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by group and word: those with near words, how many each has, and the place of its most frequent one (ties: the first)."""
    rows = len(words)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    cuts = range(0, rows, TILE)
    last = np.searchsorted(group, group, side="right") if rows else group  # a row's group ends there
    kept: dict[int, _Block] = {}

    def block(at: int) -> _Block:
        if at not in kept:
            to = slice(at, at + TILE)
            kept[at] = _Block(words[to], group[to], size[to], longer[to], a[to], b[to], at)
        return kept[at]

    for at in cuts:
        for old in [k for k in kept if k < at]:
            del kept[old]
        end = int(last[min(at + TILE, rows) - 1])
        for other in range(at, end, TILE):
            pairs.append(_tile(block(at), block(other)))
    if not pairs:
        return (np.zeros(0, np.int64),) * 3
    i, j = (np.concatenate(x) for x in zip(*pairs))
    row, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((other, -n[other], row))
    row, other = row[order], other[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    return row[first], np.diff(np.r_[first, len(row)]), other[first]


def _comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``word, n, size, longer, a, b, h`` sorted by group and word; what is left of the last group of a batch waits for the next."""

    def compared(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        group = np.zeros(rows.num_rows, np.int64)
        group[starts[1:]] = 1
        words = rows["word"].to_pylist()
        n, size, longer, a, b = (rows[c].to_numpy() for c in ("n", "size", "longer", "a", "b"))
        row, count, best = near_in_groups(words, n, np.cumsum(group), size, longer, a, b)
        return pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in row], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[k] for k in best], pa.string())],
            ["word", "near", "best_n", "best"],
        )

    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if waiting is not None:
            rows = pa.concat_tables([waiting, rows]).combine_chunks()
        keys = [rows[c].to_numpy() for c in _GROUP]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        waiting = rows.slice(int(starts[-1]))
        if len(starts) > 1:
            yield compared(rows.slice(0, int(starts[-1])), starts[:-1])
    if waiting is not None:
        yield compared(waiting, np.zeros(1, np.int64))


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, near, best_n, best`` in parts: sums and best near words (largest n, first in code-point order) of each group that a word is in."""
    found, rows = None, _halves(words)
    while True:
        sizes = rows.filter("b - a > 1").groupBy(*_GROUP).count().filter(F.col("count") > group_words)
        large = written(sizes.select(*_GROUP), "large-groups")
        over = not large.isEmpty()
        here = rows.join(large, _GROUP, "left_anti") if over else rows
        dealt = here.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "word").select("word", "n", "size", *_GROUP)
        part = dealt.mapInArrow(tidied(_comparing), "word string, near long, best_n long, best string")
        found = part if found is None else found.unionAll(part)
        if not over:
            return found
        rows = written(_finer(rows.join(large, _GROUP, "left_semi")), "finer-groups")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: where following forms ends. Each step's n is several times the last, so chains are short; they are halved each round."""
    reached = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("up"))
        next_ = written(reached.join(further, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        forget(reached)
        reached = next_.drop("moved")
        reached._ragloom_path = next_._ragloom_path
        if next_.filter("moved").isEmpty():
            return reached


def variants(words: DataFrame, times: int = 5, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of the distinct ``words`` (word, n).

    ``n_near`` counts the near words. ``form`` is the near word of largest n (ties: smallest in code-point order) if its n is ``times`` the word's or more, else
    null; ``root`` is the last form of forms, or the word itself. A word of one code point and the empty word are near. An empty table gives no rows.
    """
    words = written(words.select("word", "n"), "words")
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    parts = own.unionByName(near_words(words, group_words).withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))))
    summed = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.m") >= times * F.col("n")
    forms = written(summed.select("word", "n", "n_near", F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

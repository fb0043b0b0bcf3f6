"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of benchmark words. For each pattern length there is a table of shifts by
block (a few consecutive words): a block that ends no pattern tells how far the search
may move on at once. Where the shift is zero, the block selects the patterns that end in it; a hash of the other words
picks among them, and the words themselves are compared. Most of a text is skipped: only every eleventh block is looked at
unless it occurs in a pattern.

Tables are sorted arrays; words are numbers of the table's vocabulary. A table takes up to 30 bytes a benchmark word and 130 a distinct one.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, memory, mixed, new_path, with_results

WINDOW = 13
BLOCK = 3
#: Bytes of benchmark text of one table. More text makes more tables; a task holds one at a time.
BYTES_PER_PASS = 8 << 20
#: Bytes of documents that are searched together.
GROUP_BYTES = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and all that is not ASCII, with A-Z in lower case."""
    return _WORD.findall(text.lower())  # bytes: only A-Z change


class _Vocabulary(dict):
    """Numbers of words; -1 for words that no pattern has."""

    def __missing__(self, word: bytes | None) -> int:
        return -1


def _rows(ids: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    return [ids[starts + k] for k in range(width)]


def _spread(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first, first + 1 ...``, ``count`` numbers for each first."""
    before = np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(firsts, counts) + np.arange(int(counts.sum())) - before


class WuManber:
    """Finds patterns of one length. ``ids`` are the words of the texts ``(item, first, number)`` that patterns are windows of."""

    def __init__(self, length: int, ids: np.ndarray, texts: list[tuple[int, int, int]], block: int = BLOCK):
        self.length, self.block = length, min(block, length)
        self.last = length - self.block  # where in a pattern its last block starts
        self.ids = ids
        items, firsts, sizes = np.array(texts, np.int64).T
        windows = sizes - length + 1
        starts, of = _spread(firsts, windows), np.repeat(items, windows)
        blocks = sizes - self.block + 1
        places = _spread(firsts, blocks)
        shift = np.maximum(self.last - (places - np.repeat(firsts, blocks)), 0)  # a block further on ends a pattern
        keys = mixed(*_rows(ids, places, self.block))
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        once = np.r_[True, keys[1:] != keys[:-1]]
        self.blocks, self.shift = keys[once], shift[once].astype(np.uint8)
        keys = mixed(*_rows(ids, starts, length))
        order = np.lexsort((of, keys))
        keys, starts, of = keys[order], starts[order], of[order]
        differs = keys[1:] != keys[:-1]
        for k in range(length):  # equal keys of different windows stay apart
            differs |= ids[starts[1:] + k] != ids[starts[:-1] + k]
        first = np.flatnonzero(np.r_[True, differs])
        self.patterns, self.starts, self.items, self.items_at = keys[first], starts[first].astype(np.int32), of.astype(np.int32), np.r_[first, len(of)]

    def _shifts(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.blocks, keys), len(self.blocks) - 1)
        return np.where(self.blocks[at] == keys, self.shift[at], self.last + 1).astype(np.int64)

    def search(self, text: list[bytes | None], vocabulary: _Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns start in ``text``, and which; ``None`` stands between texts."""
        most, number = self.last + 1, vocabulary.__getitem__
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        count = len(range(self.last, len(text) - self.block + 1, most))
        if not count:
            return none
        looked = np.array([np.fromiter(map(number, text[self.last + k :: most][:count]), np.int64, count) for k in range(self.block)])
        known = np.flatnonzero((looked >= 0).all(0))
        shift = self._shifts(mixed(*looked[:, known]))
        near = shift < most
        at, shift = self.last + known[near] * most, shift[near]
        at = _spread(at + shift, most - shift)  # what the shift leaves of the way to the next look
        at = at[at <= len(text) - self.block]
        looked = np.array([np.fromiter((number(text[i + k]) for i in at.tolist()), np.int64, len(at)) for k in range(self.block)])
        ends = np.flatnonzero((looked >= 0).all(0))
        ends = ends[self._shifts(mixed(*looked[:, ends])) == 0]
        at = at[ends] - self.last
        if not len(at):
            return none
        own = np.array([np.fromiter((number(text[i + k]) for i in at.tolist()), np.int64, len(at)) for k in range(self.length)])
        keys = mixed(*own)
        left, right = np.searchsorted(self.patterns, keys, "left"), np.searchsorted(self.patterns, keys, "right")
        which, place = _spread(left, right - left), np.repeat(np.arange(len(at)), right - left)
        same = np.ones(len(which), bool)
        for k in range(self.length):
            same &= own[k][place] == self.ids[self.starts[which] + k]
        return at[place[same]], which[same]


class Table:
    """Searchers, one for each pattern length, of benchmark rows (item, text)."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary, self.names, self.searchers = _Vocabulary(), [], []
        by_length: dict[int, tuple[list[np.ndarray], list[tuple[int, int, int]]]] = {}
        numbers: dict[str | None, int] = {}
        for name, text in rows:
            w = words((text or "").encode())
            if w:
                item = numbers.setdefault(name, len(numbers))
                ids = np.fromiter((self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w), np.int32, len(w))
                parts, texts = by_length.setdefault(min(window, len(w)), ([], []))
                texts.append((item, texts[-1][1] + texts[-1][2] if texts else 0, len(w)))
                parts.append(ids)
        self.names = list(numbers)
        self.searchers = [WuManber(length, np.concatenate(parts), texts) for length, (parts, texts) in by_length.items()]

    def find(self, text: list[bytes | None], firsts: np.ndarray, number: int, spans: list[list[tuple[int, int]]], items: list[set]) -> None:
        """Adds spans and names to those of each document from ``number`` on; ``firsts`` are the places of the documents' first words."""
        for s in self.searchers:
            at, which = s.search(text, self.vocabulary)
            docs = np.searchsorted(firsts, at, "right") - 1
            for doc, start in zip(docs.tolist(), (at - firsts[docs]).tolist()):
                spans[number + doc].append((start, start + s.length))
            pairs = np.unique(np.stack([docs, which]), axis=1)
            for doc, p in pairs.T.tolist():
                items[number + doc].update(self.names[i] for i in s.items[s.items_at[p] : s.items_at[p + 1]].tolist())


def _table(path: str) -> Table:
    """The table at ``path``, kept until another is asked for."""
    kept = memory("benchmark tables")
    if path not in kept:
        kept.clear()
        fs, at = filesystem(path)
        with fs.open_input_stream(at) as file:
            kept[path] = pickle.loads(file.read())
    return kept[path]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


_FIELDS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``row, text, out`` for each row of ``docs``; ``out`` has ``n_words``, disjoint ``spans`` of hit words, ``items``.

    ``spans`` are word positions (end excluded), ``items`` the benchmark items with windows that occur, sorted as
    strings. A null or empty text has no words; a benchmark text without words has no windows, one with fewer words than a window is one window. Equal
    windows of several items count for each; rows of one item id are one item. Rows with a null item id are one item without a name, a null that comes last. Repeated
    rows of ``docs`` all come back. Texts of any length are searched whole. An empty table on either side is fine; other columns play no part, whatever
    their names. The benchmark comes to the driver, and to tasks, in tables of :data:`BYTES_PER_PASS`; each batch of documents meets one after the other.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("body"))
    size = bench.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    passes, paths = max(1, math.ceil(size / BYTES_PER_PASS)), []
    folder = new_path(spark, "benchmark-tables")
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    for k in range(passes):
        some = bench.filter(F.pmod(F.xxhash64("item", "body"), F.lit(passes)) == k) if passes > 1 else bench
        with fs.open_output_stream(f"{at}/{k}") as file:
            file.write(pickle.dumps(Table([(r[0], r[1]) for r in some.collect()], window)))
        paths.append(f"{folder}/{k}")

    def compute(texts: list[bytes]) -> list[pa.Array]:
        counts = np.zeros(len(texts), np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        for path in paths:
            table = _table(path)
            for i, j in _groups(texts):
                flat: list[bytes | None] = []
                firsts = np.zeros(j - i, np.int64)
                for k in range(i, j):
                    firsts[k - i] = len(flat)
                    flat += words(texts[k])
                    counts[k] = len(flat) - firsts[k - i]
                    flat.append(None)
                table.find(flat, firsts, i, spans, items)
        joined = [[{"start": a, "end": b} for a, b in merged(s)] for s in spans]
        names = [sorted(of, key=lambda x: (x is None, x)) for of in items]
        return [pa.array(counts), pa.array(joined, _SPANS), pa.array(names, pa.list_(pa.string()))]

    return with_results(docs, text_col, docs.columns if keep is None else keep, compute, _FIELDS, own="benchmark tables")


def n_hit() -> Column:
    return F.aggregate("out.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> Column:
    """At least a twentieth of the words are hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("out.n_words"))

"""A language model of code points, counted and trained by Spark.

Modified Kneser-Ney of order five over whole code points. N-grams are counted exactly, as 21 bits a
symbol in two longs, for each language and each half of its documents. Nothing is capped: tables grow with
what the corpus holds and stay in Spark. A row has both halves' numbers of an n-gram, so the two models are trained
at once, and each n-gram that occurs in one half has its probability under the other half's model without any search for
shorter ends. These logarithms are sorted by a 64-bit hash of the n-gram. Where they fit into a task's memory, tasks read them
whole; else they are joined with the distinct n-grams of chunks of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, forget, join_few, mixed, tidied, written

ORDER, BITS = 5, 21
MASK = (1 << BITS) - 1
#: Probability of a symbol below order one: any code point.
UNIFORM = 1 / 0x110000
#: Bytes of text whose n-grams are sorted together.
GROUP_BYTES = 512 << 10
#: Distinct n-grams that a counting task holds before it hands them on.
HELD = 600_000
#: Bytes of text of a chunk whose n-grams are joined with their values together.
CHUNK_BYTES = 8 << 20


def half(text: bytes) -> int:
    """The half of the corpus that a text counts in; equal texts are in one half."""
    return zlib.crc32(text) & 1


def language(lang: Column) -> Column:
    """The number of a language: a 64-bit hash of its whole name; null is the empty one."""
    return F.xxhash64(F.coalesce(lang.cast("string"), F.lit("")))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First symbols (``hi``) and last three (``lo``) of the n-gram that ends at each code point, and each text's code points."""
    strings = [t.decode("utf-8", "replace") for t in texts]
    lengths = np.array([len(s) for s in strings], np.int64)
    before = ORDER - 1
    pad = "\0" * before
    raw = np.frombuffer((pad + pad.join(strings)).encode("utf-32-le"), np.uint32)
    start = np.zeros(len(raw), bool)
    firsts = np.concatenate([[0], np.cumsum(lengths + before)[:-1]])
    for k in range(before):
        start[firsts + k] = True
    symbols = np.where(start, np.uint32(0), raw + np.uint32(1)).astype(np.uint64)
    at = np.flatnonzero(~start)
    pairs = (symbols[:-1] << np.uint64(BITS)) | symbols[1:]
    return pairs[at - 4], (pairs[at - 2] << np.uint64(BITS)) | symbols[at], lengths


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``h``, and where in it each distinct value starts."""
    order = np.argsort(h)
    s = h[order]
    return order, np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def count(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    """``m, hi, lo, n0, n1``: how often each n-gram occurs in each half of the language ``m``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def fold(h, m, hi, lo, n0, n1) -> tuple[np.ndarray, ...]:
            order, firsts = _distinct(h)
            at = order[firsts]
            return h[at], m[at], hi[at], lo[at], *(np.add.reduceat(n[order], firsts, dtype=np.int32) for n in (n0, n1))

        def out(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in part[1:4]), *map(pa.array, part[4:])], ["m", "hi", "lo", "n0", "n1"])

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), _texts(batch.column(1))
            for i, j in groups(texts):
                hi, lo, lengths = grams(texts[i:j])
                if not len(hi):
                    continue
                m, n1 = np.repeat(ids[i:j], lengths), np.repeat(np.array([half(t) for t in texts[i:j]], np.int32), lengths)
                held.append(fold(mixed(m, hi, lo), m, hi, lo, 1 - n1, n1))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [fold(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) > HELD // 2:
                        yield out(held.pop())
        if held:
            yield out(fold(*map(np.concatenate, zip(*held))))

    counted = docs.select(lang.alias("m"), text.cast("string").alias("text")).mapInArrow(tidied(each), "m long, hi long, lo long, n0 int, n1 int")
    return counted.groupBy("m", "hi", "lo").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _suffix(k: int) -> list[Column]:
    """The last ``k`` symbols of a row's n-gram."""
    bits = lambda n: F.lit((1 << (BITS * n)) - 1).cast("long")
    return [F.col("hi").bitwiseAND(bits(max(k - 3, 0))).alias("hi"), F.col("lo").bitwiseAND(bits(min(k, 3))).alias("lo")]


def _context() -> list[Column]:
    """The symbols of a row's n-gram but the last."""
    moved = F.shiftleft(F.col("hi").bitwiseAND(F.lit(MASK).cast("long")), 2 * BITS)
    return [F.shiftright("hi", BITS).alias("chi"), moved.bitwiseOR(F.shiftright("lo", BITS)).alias("clo")]


def _discounts(level: DataFrame) -> DataFrame:
    """``m, d01, d02, d03, d11, d12, d13`` of modified Kneser-Ney for each language and half."""
    of = level.groupBy("m").agg(*(F.sum((F.col(f"n{h}") == k).cast("double")).alias(f"n{h}{k}") for h in (0, 1) for k in (1, 2, 3, 4)))
    out = []
    for h in (0, 1):
        n = lambda k: F.nullif(F.col(f"n{h}{k}"), F.lit(0.0))  # noqa: B023, E731
        y = n(1) / (F.col(f"n{h}1") + 2 * F.col(f"n{h}2"))
        for k in (1, 2, 3):
            x = k - (k + 1) * y * F.col(f"n{h}{k + 1}") / n(k)
            out.append(F.when(x > 0, F.least(x, F.lit(float(k)))).otherwise(0.5 * k).alias(f"d{h}{k}"))
    return of.select("m", *out)


def train(counts: DataFrame) -> DataFrame:
    """``m, hi, lo, n0, n1, p0, p1``: probabilities of the n-grams of ``counts``, a table, under the model of each half.

    An n-gram that a half does not have gets what its model gives the symbol after the longest end that it knows. The groups of a window
    are the symbols after one context, so they hold no more rows than there are code points.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different symbols before
        of = levels[k + 1].select("m", *_suffix(k), *((F.col(f"n{h}") > 0).cast("int").alias(f"n{h}") for h in (0, 1)))
        levels[k] = written(of.groupBy("m", "hi", "lo").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), f"level-{k}")
    below = None
    for k in range(1, ORDER + 1):
        few = written(_discounts(levels[k]), "discounts")
        rows = join_few(levels[k], few, "m", "hi", "lo").select("m", "hi", "lo", "n0", "n1", *_context(), *(
            F.when(F.col(f"n{h}") == 0, 0.0).when(F.col(f"n{h}") == 1, F.col(f"d{h}1")).when(F.col(f"n{h}") == 2, F.col(f"d{h}2")).otherwise(F.col(f"d{h}3")).alias(f"d{h}") for h in (0, 1)
        ))
        after = Window.partitionBy("m", "chi", "clo")
        rows = rows.select("*", *(F.sum(f"{x}{h}").over(after).alias(f"{name}{h}") for h in (0, 1) for x, name in (("n", "total"), ("d", "freed"))))
        if below is None:
            rows = rows.withColumn("lower0", F.lit(UNIFORM)).withColumn("lower1", F.lit(UNIFORM))
        else:
            low = below.select("m", F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p0").alias("lower0"), F.col("p1").alias("lower1"))
            s = _suffix(k - 1)
            rows = rows.withColumn("shi", s[0]).withColumn("slo", s[1]).join(low, ["m", "shi", "slo"])
        p = [
            F.when(F.col(f"total{h}") > 0, (F.col(f"n{h}") - F.col(f"d{h}")) / F.col(f"total{h}") + F.col(f"freed{h}") / F.col(f"total{h}") * F.col(f"lower{h}")).otherwise(F.col(f"lower{h}")).alias(f"p{h}")
            for h in (0, 1)
        ]
        last, below = below, written(rows.select("m", "hi", "lo", *["n0", "n1"] * (k == ORDER), *p), f"probabilities-{k}")
        forget(few, levels[k], *[last] * (last is not None))
    return below


def values(trained: DataFrame) -> DataFrame:
    """``key, v``, a table sorted by key: the log probability of each n-gram of a half under the model of the other half."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, hi, lo, n0, n1, p0, p1 = (c.to_numpy() for c in batch.columns)
            for h, n, p in ((0, n0, p1), (1, n1, p0)):
                has = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(mixed(m[has], np.uint64([h]), hi[has], lo[has]).view(np.int64)), pa.array(np.log(p[has]))], ["key", "v"])

    found = written(trained.mapInArrow(each, "key long, v double").repartitionByRange("key").sortWithinPartitions("key"), "values")
    forget(trained)
    return found


class Model:
    """The values of n-grams in sorted arrays, read when a task first needs them."""

    def __init__(self, path: str):
        self.path, self.held = path, None

    def __getstate__(self):
        return self.path

    def __setstate__(self, state):
        self.__init__(state)

    def release(self) -> None:
        self.held = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        if self.held is None:
            from pyarrow import dataset

            fs, at = filesystem(self.path)
            rows = dataset.dataset(at, filesystem=fs, format="parquet").to_table(columns=["key", "v"])
            k, v = (rows.column(c).to_numpy() for c in ("key", "v"))
            del rows
            if len(k) and (k[1:] < k[:-1]).any():  # files of another order
                order = np.argsort(k)
                k, v = k[order], v[order]
            self.held = k, v
        return self.held[1][np.searchsorted(self.held[0], keys)]


def _keys(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the n-gram that ends at each code point, and each text's code points."""
    hi, lo, lengths = grams(texts)
    return mixed(np.repeat(ids, lengths), np.repeat(np.array([half(t) for t in texts], np.uint64), lengths), hi, lo).view(np.int64)[: len(hi)], lengths


def log_perplexity(texts: list[bytes], ids: list[int], find: Callable[[np.ndarray], np.ndarray]) -> tuple[list[float | None], list[int]]:
    """Log perplexity of each text (null if it is empty) under its language's other half, and its code points."""
    out: list[float | None] = []
    sizes: list[int] = []
    for i, j in groups(texts):
        keys, lengths = _keys(texts[i:j], np.array(ids[i:j], np.int64))
        order, firsts = _distinct(keys)
        found = np.zeros(len(keys))
        if len(keys):
            found[order] = np.repeat(find(keys[order[firsts]]), np.diff(np.r_[firsts, len(keys)]))
        sums = np.concatenate([[0.0], np.cumsum(found)])
        ends = np.cumsum(lengths)
        out += [-(sums[e] - sums[e - n]) / n if n else None for e, n in zip(ends.tolist(), lengths.tolist())]
        sizes += lengths.tolist()
    return out, sizes


def by_join(source: DataFrame, found: DataFrame, compute: Callable[[pa.Table, Callable[[np.ndarray], np.ndarray]], pa.Table], schema: T.StructType, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``compute`` over chunks of ``source`` (``row, text, m``) with the values of the chunk's n-grams; for values that no task can hold.

    Rows are dealt at random to chunks of about ``chunk_bytes``; only distinct n-grams of a chunk are shuffled.
    """
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    dealt = source.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))
    dealt = written(dealt.repartition("chunk").sortWithinPartitions("chunk"), "chunks")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, chunk = _texts(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]).tolist() if len(chunk) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for i, j in groups(texts[a:b]):
                    keys = np.unique(_keys(texts[a + i : a + j], ids[a + i : a + j])[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk[a])), pa.array(keys)], ["chunk", "key"])

    wanted = dealt.select("text", "m", "chunk").mapInArrow(tidied(distinct), "chunk long, key long").distinct()
    known = wanted.join(found, "key").select("chunk", "key", "v")

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        k, v = (right.column(c).to_numpy() for c in ("key", "v"))
        order = np.argsort(k)
        k, v = k[order], v[order]
        return compute(left, lambda keys: v[np.searchsorted(k, keys)])

    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(together, T.StructType([dealt.schema["row"], *schema.fields[1:]]))

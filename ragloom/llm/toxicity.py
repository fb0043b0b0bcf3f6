"""Toxicity by a factorization machine over hashed terms.

Terms are words and beginnings of words, hashed. The machine gives each term a weight and a vector;
the inner products of the vectors weigh pairs of terms in one text, such as an insult and the mention of a
group, that a sum of weights misses. It is trained here, on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_results

HASHES = 1 << 20
#: Length of the beginnings that words count with, besides the whole word.
BEGINNING = 4
#: Labelled rows that the machine is fitted on: those with the smallest hash of their id.
TRAINING_ROWS = 12_000
#: Texts that a term must be in to get a weight, and its least chi-square against the label.
LEAST_TEXTS, LEAST_CHI2 = 3, 8.0
#: Terms that no single effect chooses are chosen in pairs: toxic texts that the others leave below EXPLAINED and that share the pair,
#: how many times as many as chance gives, and the pair's least chi-square against the label.
EXPLAINED, PAIR_TEXTS, PAIR_LIFT, PAIR_CHI2 = 0.5, 5, 4.0, 40.0
FACTORS, EPOCHS, RATE, SHRINK = 8, 12, 0.1, 1e-5
THRESHOLD = 0.3
REMEMBERED_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[int]:
    """The hashed terms of a word in lower case."""
    own = [zlib.crc32(b"w" + word.encode()) % HASHES]
    if len(word) >= BEGINNING:
        own.append(zlib.crc32(b"b" + word[:BEGINNING].encode()) % HASHES)
    return own


def text_words(text: bytes) -> set[str]:
    return set(_WORD.findall(text.decode("utf-8", "replace").lower()))


class Machine:
    """``terms``: the sorted hashes that have weights."""

    def __init__(self, terms_: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.terms, self.bias, self.weights, self.vectors = terms_, bias, weights, vectors
        self.words: dict[str, tuple[int, ...]] = {}

    def _places(self, word: str) -> tuple[int, ...]:
        hashes = terms(word)
        at = np.searchsorted(self.terms, hashes)
        return tuple(int(a) for a, h in zip(at, hashes) if a < len(self.terms) and self.terms[a] == h)

    def score(self, text: bytes) -> float:
        known, found = self.words, set()
        for word in text_words(text):
            places = known.get(word)
            if places is None:
                if len(known) >= REMEMBERED_WORDS:
                    known.clear()
                places = known[word] = self._places(word)
            if places:
                found.update(places)
        logit = self.bias
        if found:
            at = np.fromiter(sorted(found), np.int64, len(found))
            v = self.vectors[at]
            logit += float(self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def __getstate__(self):
        return self.terms, self.bias, self.weights, self.vectors

    def __setstate__(self, state):
        self.__init__(*state)


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine of texts (arrays of their distinct hashed terms) and labels 0 or 1."""
    n, positive = len(rows), int(labels.sum())
    if not positive or positive == n:
        base = (positive + 0.5) / (n + 1) if n else 0.01
        return Machine(np.zeros(0, np.int64), float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, FACTORS)))
    sizes = np.array([len(r) for r in rows])
    flat, of = np.concatenate(rows), np.repeat(np.arange(n), sizes)
    vocabulary, at = np.unique(flat, return_inverse=True)
    seen = np.bincount(at, minlength=len(vocabulary)).astype(float)
    seen_positive = np.bincount(at, labels[of], len(vocabulary))
    enough = seen >= LEAST_TEXTS
    chosen = enough & (_chi2(seen_positive, seen, positive / n) >= LEAST_CHI2)
    w, v, bias = _descend(at, of, chosen, labels, seed)
    logit = _logits(at, of, chosen, n, w, v, bias)
    left = labels.astype(bool) & (logit < np.log(EXPLAINED / (1 - EXPLAINED)))
    more = _pair_terms(at, of, enough, seen, labels, left)
    if (more & ~chosen).any():
        chosen |= more
        w, v, bias = _descend(at, of, chosen, labels, seed)
    return Machine(vocabulary[chosen], bias, w, v)


def _chi2(found: np.ndarray, of: np.ndarray, rate: float) -> np.ndarray:
    """Chi-square of ``found`` positive ones of ``of``."""
    expected = of * rate
    return (found - expected) ** 2 / expected + (found - expected) ** 2 / (of - expected + 1e-9)


def _rows_of(starts: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists ``which`` one after the other, and the length of each list."""
    sizes = starts[which + 1] - starts[which]
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts[which] - before, sizes) + np.arange(sizes.sum())], sizes


def _pair_terms(at: np.ndarray, of: np.ndarray, enough: np.ndarray, seen: np.ndarray, labels: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which terms are in a pair that tells the label, though each alone may not: looked for in the texts ``left``, counted in all.

    The pairs of one term are counted at a time, so memory grows with the sample's terms and not with its pairs.
    """
    n, terms_ = len(labels), len(enough)
    in_left = np.bincount(at[left[of]], minlength=terms_)
    usable = np.flatnonzero(enough & (in_left >= PAIR_TEXTS))
    number = np.full(terms_, -1)
    number[usable] = np.arange(len(usable))
    at, of = number[at], of[number[at] >= 0]
    at = at[at >= 0]
    by_text, by_term = np.lexsort((at, of)), np.lexsort((of, at))
    text_starts, term_starts = np.searchsorted(of[by_text], np.arange(n + 1)), np.searchsorted(at[by_term], np.arange(len(usable) + 1))
    texts, terms_of = of[by_term], at[by_text]
    seen, rate = seen[usable], labels.sum() / n
    found = np.zeros(len(usable), bool)
    for x in range(len(usable)):
        mine = texts[term_starts[x] : term_starts[x + 1]]
        counts = np.bincount(_rows_of(text_starts, terms_of, mine[left[mine]])[0], minlength=len(usable))
        likely = (counts >= PAIR_TEXTS) & (counts >= PAIR_LIFT * left.sum() * seen[x] * seen / n**2)
        likely[: x + 1] = False  # a pair is counted with its first term
        if likely.any():
            others, sizes = _rows_of(text_starts, terms_of, mine)
            both, positive = np.bincount(others, minlength=len(usable)), np.bincount(others, np.repeat(labels[mine], sizes), len(usable))
            telling = likely.copy()
            telling[likely] = _chi2(positive[likely], both[likely].astype(float), rate) >= PAIR_CHI2
            found |= telling
            found[x] |= telling.any()
    out = np.zeros(terms_, bool)
    out[usable[found]] = True
    return out


def _used(at: np.ndarray, of: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = chosen[at]
    return (np.cumsum(chosen) - 1)[at[keep]], of[keep]


def _logits(at: np.ndarray, of: np.ndarray, chosen: np.ndarray, n: int, w: np.ndarray, v: np.ndarray, bias: float) -> np.ndarray:
    at, of = _used(at, of, chosen)
    squares = np.bincount(of, (v[at] ** 2).sum(1), n)
    sums = sum(np.bincount(of, v[at, k], n) ** 2 for k in range(v.shape[1]))
    return bias + np.bincount(of, w[at], n) + 0.5 * (sums - squares)


def _descend(at: np.ndarray, of: np.ndarray, chosen: np.ndarray, labels: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and vectors of the chosen terms, and the bias, by adaptive gradient steps."""
    n, positive = len(labels), int(labels.sum())
    at, of = _used(at, of, chosen)
    starts = np.searchsorted(of, np.arange(n + 1))
    random = np.random.default_rng(seed)
    k = int(chosen.sum())
    w, v, bias = np.zeros(k), random.normal(0, 0.01, (k, FACTORS)), float(np.log(positive / (n - positive)))
    gw, gv, gb = np.full(k, 1e-6), np.full((k, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for first in range(0, n, 128):
            rows_ = order[first : first + 128]
            counts = starts[rows_ + 1] - starts[rows_]
            local = np.repeat(np.arange(len(rows_)), counts)
            ids = at[np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows_])] if counts.sum() else np.zeros(0, np.int64)
            sums = np.zeros((len(rows_), FACTORS))
            np.add.at(sums, local, v[ids])
            squares = np.bincount(local, (v[ids] ** 2).sum(1), len(rows_))
            logit = bias + np.bincount(local, w[ids], len(rows_)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows_])
            gb += (error.mean()) ** 2
            bias -= RATE * error.mean() / np.sqrt(gb)
            touched, inverse = np.unique(ids, return_inverse=True)
            dw = np.bincount(inverse, error[local], len(touched)) + SHRINK * w[touched]
            dv = np.zeros((len(touched), FACTORS))
            np.add.at(dv, inverse, error[local][:, None] * (sums[local] - v[ids]))
            dv += SHRINK * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
    return w, v, bias


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of a sample of at most ``rows`` labelled ids that are not held out. Of repeated rows of an id one comes, the first by its terms."""
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    eligible = named.filter(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) != 2)
    sample = eligible.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def compute(texts: list[bytes], label: list[int], ids: list[str]) -> list[pa.Array]:
        found = [sorted({h for w in text_words(t) for h in terms(w)}) for t in texts]
        return [pa.array(found, pa.list_(pa.int32())), pa.array(label, pa.int32()), pa.array(ids, pa.string())]

    texts_ = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = texts_.join(F.broadcast(sample), "id")  # at most ``rows`` ids
    found = with_results(chosen, "text", [], compute, "terms array<int>, label int, id string", extra=("label", F.col("id").cast("string"))).select("out.*")
    out = found.groupBy("id").agg(F.min(F.struct("terms", "label")).alias("first")).select("first.*").toArrow()  # so an id that is repeated is one row
    lists = []
    for chunk in out.column("terms").chunks:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        lists += [values[a:b] for a, b in zip(at[:-1], at[1:])]
    return lists, out.column("label").to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Machine:
    """A machine of a sample of labelled rows (see :func:`training_rows`). Null ids and labels, and ids without a row, teach nothing; without toxic rows, or with
    none but these, and from empty tables, all texts get one score. Other columns play no part."""
    found, of = training_rows(docs, labels, id_col, text_col, label_col, rows)
    order = sorted(range(len(found)), key=lambda i: (len(found[i]), found[i].tobytes(), of[i]))  # whatever order tasks end in
    return fit([found[i] for i in order], of[order])


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Rows ``row, text, out`` with ``out.score`` from 0 to 1 for each row of ``docs``.

    Null and empty texts get the score of a text without terms. Long texts are scored whole. Repeated
    rows get equal scores and all come back, as do rows with a null id; other columns play no part, whatever their names. An empty table gives
    an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def compute(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([model.value.score(t) for t in texts], pa.float64())]

    return with_results(docs, text_col, docs.columns if keep is None else keep, compute, "score double", release=lambda: model.value.words.clear())

"""Spelling variants against all pairs by plain edit distance."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import *  # noqa: F403

from ragloom.llm import spelling_variants as S


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:k] + long_[k + 1 :] == short for k in range(len(long_)))


def plain_variants(counts: dict[str, int], times: int = 5) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] is not None else None) for w, n in counts.items()}


def vocabulary(seed: int, n: int, alphabet: str = "abé") -> dict[str, int]:
    r = random.Random(seed)
    words = {"".join(r.choice(alphabet) for _ in range(r.randrange(1, 9))) for _ in range(n)}
    return {w: r.choice([1, 5, 5, 25, 30, 125, 700]) for w in words}


def found(spark, counts, **options):
    rows = S.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), **options).collect()
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("group_words", [4096, 3])  # at 3 groups are dealt again down to single code points
def test_all_near_words_are_found(spark, group_words):
    counts = vocabulary(1, 260)
    assert found(spark, counts, group_words=group_words) == plain_variants(counts)


def test_wide_code_points_and_long_words(spark):
    counts = vocabulary(2, 60, "日本𝕏a") | {"x" * 3000: 5, "x" * 2999: 100, "x" * 1500 + "y" + "x" * 1499: 600, "": 7, "q": 1}
    assert found(spark, counts) == plain_variants(counts)


def test_groups_larger_than_a_tile():
    r = np.random.default_rng(3)
    words = sorted({"pre" + "".join(r.choice(list("abc"), 6)) for _ in range(500)})
    size = np.full(len(words), 9)
    row, count, best = S.near_in_groups(words, np.arange(len(words)) % 7, np.zeros(len(words)), size, size, np.zeros(len(words)), size)
    expected = {w: [v for v in words if one_edit(w, v)] for w in words}
    assert {words[k]: c for k, c in zip(row, count)} == {w: len(v) for w, v in expected.items() if v}
    n = {w: k % 7 for k, w in enumerate(words)}
    assert all(words[b] == min(expected[words[k]], key=lambda v: (-n[v], v)) for k, b in zip(row, best))


def test_counts_with_planted_slips(spark, docs):
    counts = Counter()
    for r in docs.collect():
        lowered = (r.text or "").encode().lower().decode()
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    got = {r.word: r.n for r in S.count_words(docs, slip_every=3, least_chars=4, least_n=2).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 4 and n >= 2}


def test_odd_rows(spark, docs, no_docs):
    assert S.variants(S.count_words(no_docs)).count() == 0
    twice = docs.filter("doc_id = 7").unionAll(docs.filter("doc_id = 4"))
    assert [(r.word, r.n) for r in S.count_words(twice.unionAll(twice), least_chars=3, least_n=1).collect()] == [("one", 2)]
    nulls = spark.createDataFrame([(None, "wordsmith " * 5, "x"), (None, None, "x")], "doc_id long, text string, word string")
    assert [(r.word, r.n) for r in S.count_words(nulls, slip_every=10**9).collect()] == [("wordsmith", 5)]

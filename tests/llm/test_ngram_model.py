"""The language model of code points against a plain version, and the bands that it gives."""

import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from ragloom.llm import ngram_model, quality

CYRILLIC = ["мир дом вода лес", "дом вода мир", "лес мир \U0001f600 дом", "вода\0вода", "日本語 дом мир лес вода"]


def plain_log_perplexity(text, others):
    """Interpolated modified Kneser-Ney of order five over code points, trained on ``others``."""
    size = 5
    padded = lambda t: [None] * (size - 1) + list(t)
    levels = {size: Counter(tuple(s[i : i + size]) for s in map(padded, others) for i in range(len(s) - size + 1))}
    for k in range(size - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(k, g):
        if not k:
            return 1 / 0x110000
        c, g = levels[k], g[-k:]
        n = Counter(c.values())
        d = []
        for j, fallback in ((1, 0.5), (2, 1.0), (3, 1.5)):
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else math.nan
            x = j - (j + 1) * y * n[j + 1] / n[j] if n[j] else math.nan
            d.append(min(x, j) if x > 0 else fallback)
        of = {h: m for h, m in c.items() if h[:-1] == g[:-1]}
        if not of:
            return p(k - 1, g)
        total, freed = sum(of.values()), sum(d[min(m, 3) - 1] for m in of.values())
        return max(of[g] - d[min(of[g], 3) - 1] if g in of else 0, 0) / total + freed / total * p(k - 1, g)

    s = padded(text)
    return -sum(math.log(p(size, tuple(s[i : i + size]))) for i in range(len(text))) / len(text)


def test_scores_are_those_of_the_other_half(spark):
    texts = CYRILLIC + [prose(k, 6) for k in range(5)]  # noqa: F405
    docs = spark.createDataFrame([(1, t) for t in texts], "m long, text string").repartition(2)
    counts = ngram_model.written(ngram_model.count(docs, F.col("m"), F.col("text")), "counts")
    grams = Counter(tuple(([None] * 4 + list(t))[i : i + 5]) for t in texts for i in range(len(t)))
    assert counts.count() == len(grams) and counts.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] == sum(grams.values())
    values = ngram_model.values(ngram_model.train(counts))
    keys = [r.key for r in values.collect()]
    assert keys == sorted(keys)
    halves = defaultdict(list)
    for t in texts:
        halves[ngram_model.half(t.encode())].append(t)
    assert len(halves) == 2
    found, sizes = ngram_model.log_perplexity([*(t.encode() for t in texts), b""], [1] * (len(texts) + 1), ngram_model.Model(values._ragloom_path).find)
    assert found.pop() is None and sizes == [*map(len, texts), 0]
    for t, x in zip(texts, found, strict=True):
        assert x == pytest.approx(plain_log_perplexity(t, halves[1 - ngram_model.half(t.encode())]), abs=1e-9)


def gibberish(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(300))


def test_gibberish_is_above_the_band(spark):
    usual = [(i, prose(100 + i, 300), "en") for i in range(60)]  # noqa: F405
    rows = quality.judge(spark.createDataFrame([*usual, *((1000 + k, gibberish(k), "en") for k in range(3))], "doc_id long, text string, lang string"), keep=["doc_id"]).collect()
    for r in rows:
        if r.row.doc_id >= 1000:
            assert not r.base_failed and r.perplexity > r.high and not r.kept


def test_languages_have_their_own_bands(spark):
    letters = lambda t: t.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"))
    many = [(i, prose(200 + i, 80), "en") for i in range(60)]  # noqa: F405
    few = [(100 + i, letters(prose(300 + i, 80)), "ro") for i in range(20)]  # noqa: F405
    docs = spark.createDataFrame(many + few, "doc_id long, text string, lang string")
    rows = quality.judge(docs, keep=["doc_id", "lang"]).collect()
    assert len({(r.row.lang, r.out.lang_id) for r in rows}) == 2
    alone = {r.row.doc_id: r.perplexity for r in quality.judge(docs.filter("lang = 'ro'"), keep=["doc_id"]).collect()}
    assert {r.row.doc_id: round(r.perplexity, 6) for r in rows if r.row.lang == "ro"} == {i: round(x, 6) for i, x in alone.items()}
    assert sum(r.kept for r in rows if r.row.lang == "ro") > 15


def test_bands_do_not_move_with_partitions(spark):
    r = random.Random(5)
    logs = [(k % 2, r.gauss(1.5, 0.05)) for k in range(20_000)]
    scored = spark.createDataFrame([*logs, (0, None), (2, None)], "lang_id long, log_perplexity double")
    found = [{b.lang_id: b for b in quality.bands(scored.repartition(n)).collect()} for n in (1, 7)]
    assert found[0] == found[1] and set(found[0]) == {0, 1}
    for lang, b in found[0].items():
        own = sorted(x for k, x in logs if k == lang)
        exact = [own[round(p * (len(own) - 1))] for p in (0.16, 0.5, 0.84)]
        assert (b.middle, b.below, b.above) == pytest.approx((exact[1], exact[1] - exact[0], exact[2] - exact[1]), abs=3e-4)
    assert not quality.bands(scored.limit(0)).collect()

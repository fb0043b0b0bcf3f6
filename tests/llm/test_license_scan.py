"""License rules and scans against a plain scan with Python's regular expressions."""

import random
import re

import pytest
from conftest import *  # noqa: F403
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.llm import license_scan as L
from ragloom.llm.license_rules import MOST_WORDS, RULES, STEMS, WEIGHTS

LICENSE_WORDS = "mit apache gnu general public lesser license version 2 3 0 under the licensed creative commons attribution by cc nc terms of copyright 2020".split()


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.number}-{r.label}")
def test_keyword_stem_and_length(rule):
    @settings(max_examples=8, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(rule.pattern.replace(r"\S", "[a-z0-9]").replace(r"\d", "[0-9]"), fullmatch=True))
    def each(match):
        words = match.split()
        assert rule.keyword in match
        assert any(stem in " ".join(words) for stem in STEMS), words

    each()
    longest = re.sub(r"\{\d+,(\d+)\}", lambda m: "+" * 0 + f"<{m[1]}>", rule.pattern)
    most = len(rule.pattern.split()) + sum(int(n) for n in re.findall(r"<(\d+)>", longest))
    assert most <= MOST_WORDS + 16 and rule.tier in WEIGHTS


def plain_scan(text: str | None, block_words: int = L.BLOCK_WORDS):
    lowered = (text or "").translate(str.maketrans(L.UPPER, L.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    joined = " ".join(words)
    places = [(k, label) for k in range(len(words)) for p, label in L.BASE.items() if words[k : k + len(p.split())] == p.split()]
    found = []
    for at in range(0, len(words), block_words):
        t = " " + "  ".join(words[at : at + block_words + MOST_WORDS]) + " "
        for r in RULES:
            if any(s in joined for s in STEMS) and r.keyword in t:
                for m in re.finditer(r.pattern, t):
                    start = at + t[: m.start()].count(" ") // 2
                    if start < at + block_words:
                        found.append((start, start + m[0].count(" ") // 2, r.tier, r.number, r.label))
    kept = [d for d in found if not any(e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and (e[0], -e[1], e[2], e[3]) < (d[0], -d[1], d[2], d[3]) for e in found)]
    base = sorted({label for _, label in places})
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min((k for k, _ in places), default=None), "last_word": max((k for k, _ in places), default=None), "base_labels": base,
        "detections": sorted(kept, key=lambda d: (d[0], -d[1], d[2], d[3])), "labels": sorted({*base, *(d[4] for d in kept)}), "score": max((WEIGHTS[d[2]] for d in kept), default=0.0),
    }


def test_scan_is_the_plain_scan(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(LICENSE_WORDS) for _ in range(r.randrange(60))) for _ in range(120)]
    texts += ["Licensed under the Apache License, Version 2.0.\n" * 40, "mit license " * 500, "GNU Lesser General Public License v2.1; MIT-License\tmit  LICENSE", None, "", "K license K mit license é"]
    texts += [" ".join(r.choice(LICENSE_WORDS) for _ in range(700))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block_words, chunk in ((L.BLOCK_WORDS, L.CHUNK), (50, 3)):
        for row in L.scan(docs, block_words=block_words, chunk=chunk).collect():
            got = row.out.asDict()
            got["detections"] = [(d.start, d.stop, d.tier, d.rule, d.label) for d in got["detections"]]
            assert got == plain_scan(texts[row.row.doc_id], block_words), texts[row.row.doc_id]


def test_containment_and_priority(spark):
    docs = spark.createDataFrame([(1, "This work is licensed under the GNU Lesser General Public License, version 3."), (2, "Creative Commons"), (3, "no terms here")], "doc_id long, text string")
    out = {r.row.doc_id: r.out for r in L.scan(docs).collect()}
    assert out[1].labels == ["gpl", "lgpl-3.0"] and out[1].base_labels == ["gpl"]  # the base label stays, weaker rules inside do not
    assert (out[2].labels, out[2].score) == (["creative-commons"], 0.3)
    assert (out[3].labels, out[3].score) == ([], 0.0)


def test_odd_rows_and_plan(spark, docs, no_docs):
    assert L.scan(no_docs).count() == 0
    odd = docs.select("*", *(F.lit("clash").alias(c) for c in ("out", "words", "found", "bases", "rest", "_present", "labels", "w", "t")))
    rows = L.scan(odd).collect()
    assert len(rows) == docs.count() and all(r.row.found == "clash" and r.out.labels == [] for r in rows)
    plan = L.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Scan")[0].replace("Exchange RoundRobin", "").replace("REPARTITION", "")

"""Decontamination, quality, toxicity, URL lists, WARC and HTML against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from ragloom.llm import decontamination, html_extraction, ngram_model, quality, toxicity, url_lists, warc
from ragloom.llm.common import new_path
from ragloom.llm.html_blocks import blocks


# --- decontamination -------------------------------------------------------------------------------------------------


def plain_hits(text, items):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, of = word(text), set(), set()
    for item, body in items:
        b = word(body)
        size = min(13, len(b))
        for i in range(len(b) - size + 1 if size else 0):
            for k in range(len(w) - size + 1):
                if w[k : k + size] == b[i : i + size]:
                    hit.update(range(k, k + size))
                    of.add(item if item is None else str(item))
    return len(w), len(hit), sorted(of, key=lambda x: (x is None, x))


def contamination_cases():
    items = [(None, prose(50, 14)), (None, prose(52, 20)), (0, prose(50, 30)), (1, prose(50, 20)), (2, "Two words"), (3, None), (4, ""), (5, "..."), (6, "Ärger ß 日本"), (7, prose(51, 13)), (8, "one"), (9, prose(50, 30))]  # noqa: F405
    texts = [None, "", prose(50, 30), prose(60, 40) + " " + prose(50, 30) + " " + prose(61, 5), prose(50, 12), "x two, WORDS! two words", "ärger ß 日本", "Ärger ß 日本 Ärger ß 日本", prose(51, 13) + " " + prose(51, 13), "one One ONE", prose(52, 19), prose(52, 13) * 2]  # noqa: F405
    return items, list(enumerate(texts)) + [(2, prose(50, 30))]  # noqa: F405


@pytest.mark.parametrize("per_pass", [1 << 20, 200])
def test_contamination(spark, monkeypatch, per_pass):
    monkeypatch.setattr(decontamination, "BYTES_PER_PASS", per_pass)
    items, texts = contamination_cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(spark.createDataFrame(texts, "doc_id long, text string"), bench, keep=["doc_id"])
    rows = found.select("row.doc_id", "out.n_words", decontamination.n_hit().alias("n_hit"), "out.items").collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in rows) == sorted((i, *plain_hits(t, items)) for i, t in texts)


def test_contamination_of_documents(docs, no_docs, spark):
    bench = spark.createDataFrame([(1, prose(1, 60))], "item_id long, text string")  # noqa: F405
    rows = decontamination.find_contamination(docs, bench).select("row.doc_id", "text", "row.score", decontamination.contaminated().alias("c")).collect()
    assert len(rows) == len(ROWS) and {r.doc_id for r in rows if r.c} == {1, 2, 3} and all(r.score == 1.5 for r in rows)  # noqa: F405
    assert decontamination.find_contamination(no_docs, bench).count() == 0
    assert decontamination.find_contamination(docs, bench.limit(0)).filter("size(out.items) > 0").count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def plain_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_base_counts():
    r = random.Random(3)
    texts = [t for _, t, *_ in ROWS if len(t or "") < 5000]  # noqa: F405
    texts += ["a b c d e f g h " * 3, "a b c d e f g h i", "a " * 30, "x\n\nx\n x\nx", "## * <a> |", prose(7, 30) + " " + prose(8, 9) + " " + prose(7, 30)]  # noqa: F405
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(40))) + "\n" * r.randrange(3) for _ in range(300)]
    for t in texts:
        assert quality.base_counts((t or "").encode()) == plain_counts(t), t


def test_judge(spark, docs, no_docs):
    rows = quality.judge(docs, keep=["doc_id", "n_words"]).collect()
    assert len(rows) == len(ROWS)  # noqa: F405
    for r in rows:
        text = next(t for i, t, *_ in ROWS if i == r.row.doc_id)  # noqa: F405
        assert tuple(r.out)[:5] == plain_counts(text)
        assert r.base_failed == (r.out.n_words < 20 or 100 * r.out.n_repeat_words > 30 * r.out.n_words)
        assert not (r.kept and r.base_failed) and (r.kept or r.base_failed or r.perplexity is not None)
    assert quality.judge(no_docs).count() == 0
    usual = [(i, prose(100 + i, 80 + i), "en") for i in range(60)]  # noqa: F405
    odd = [(1000, "".join(chr(33 + (i * i * 7919 + i * 31) % 94) + " " * (i % 5 == 0) for i in range(600)), "en"), (1001, "zq zq# " + " ".join(f"a{k}" * 9 for k in range(40)), "en")]
    kept = {r.row.doc_id: r.kept for r in quality.judge(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string"), keep=["doc_id"]).collect()}
    assert all(kept[i] for i, *_ in usual) and not kept[1000]


@pytest.mark.parametrize("chunk_bytes", [1 << 10, 1 << 20])
def test_both_ways_of_finding_values_agree(docs, monkeypatch, chunk_bytes):
    def found():
        rows = quality.judge(docs).collect()
        assert all(r.row.score == 1.5 for r in rows)
        return sorted((r.row.doc_id, r.text or "", r.kept, round(math.log(r.perplexity or 1), 8)) for r in rows)

    once = found()
    monkeypatch.setattr(quality, "VALUES_PER_TASK", 10)
    monkeypatch.setattr(ngram_model.by_join, "__defaults__", (chunk_bytes,))
    assert found() == once


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_machine_learns_a_pair():
    r = random.Random(6)
    rows, labels = [], []
    for _ in range(1500):
        words = {"w%d" % r.randrange(300) for _ in range(20)}
        a, b = r.random() < 0.3, r.random() < 0.3
        words |= {"insult"} if a else set()
        words |= {"group"} if b else set()
        rows.append(np.array(sorted({h for w in words for h in toxicity.terms(w)}), np.int64))
        labels.append(float(a and b))
    machine = toxicity.fit(rows, np.array(labels))
    score = lambda t: machine.score(t.encode())
    assert score("w1 insult w2 group w3") > 0.5 > score("w1 insult w2 w3") and score("w1 group w2") < 0.3 and score("") < 0.3


def test_machine_learns_a_pair_whose_members_tell_nothing():
    r = random.Random(11)
    rows, labels = [], []
    for i in range(4000):
        words = {f"w{r.randrange(3000)}" for _ in range(40)}
        kind = r.random()
        if kind < 0.04:  # together: toxic; either alone is as often toxic as any text
            words |= {"kettle", "violet"}
        elif kind < 0.30:
            words.add(r.choice(["kettle", "violet"]))
        toxic = {"kettle", "violet"} <= words
        if not toxic and not words & {"kettle", "violet"}:
            toxic = r.random() < 0.16
        rows.append(np.unique([h for w in words for h in toxicity.terms(w)]))
        labels.append(float(toxic))
    machine = toxicity.fit(rows, np.array(labels))
    both, one, none = (machine.score(t.encode()) for t in ("kettle violet", "kettle", "nothing"))
    assert both > 0.8 and one < 0.3 and none < 0.3, (both, one, none)


@pytest.mark.parametrize("text", [b"", b"kettle", b"kettle violet unknown kettle", "Ärger kettle".encode()])
def test_score_is_the_sum_over_pairs(text):
    r = np.random.default_rng(5)
    known = np.unique([h for w in ("kettle", "violet", "ärger") for h in toxicity.terms(w)])
    machine = toxicity.Machine(known, -1.5, r.normal(size=len(known)), r.normal(size=(len(known), toxicity.FACTORS)))
    mine = [k for k, h in enumerate(known) if h in {t for w in toxicity.text_words(text) for t in toxicity.terms(w)}]
    logit = machine.bias + sum(machine.weights[k] for k in mine)
    for i in range(len(mine)):
        for j in range(i):
            logit += sum(machine.vectors[mine[i]][f] * machine.vectors[mine[j]][f] for f in range(toxicity.FACTORS))
    assert machine.score(text) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-12)


def test_toxicity_on_held_out_rows(spark, no_docs):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.train(table, labels)
    scored = toxicity.score(table, machine, keep=["doc_id"]).select("row.doc_id", "out.score").join(labels, "doc_id").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).toPandas()
    positive, negative = scored[scored.toxic == 1].score, scored[scored.toxic == 0].score
    assert (positive >= 0.3).mean() > 0.85 and (negative >= 0.3).mean() < 0.01
    assert toxicity.score(no_docs, machine).count() == 0


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    rows = toxicity.score(docs, machine, keep=["doc_id"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.out.score <= 1 for r in rows)  # noqa: F405
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.row.doc_id].add(r.out.score)
    assert len(by_id[12]) == 1 and by_id[4] == by_id[5] == by_id[6]
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none, keep=["doc_id"]).filter("out.score >= 0.3").count() == 0


def test_held_out_labels_are_never_used(spark, docs):
    from zlib import crc32

    rows = [(i, 1) for i, *_ in ROWS]  # noqa: F405
    of, _ = toxicity.training_rows(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert len(of) == len({i for i, *_ in ROWS if crc32(str(i).encode()) % 4 != 2})  # noqa: F405  # rows of one id come once


# --- URL lists -------------------------------------------------------------------------------------------------------


def plain_url_verdict(url, day, entries):
    match = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
    host = re.sub(r"(:\d*)?$", "", match[1].split("@")[-1]).rstrip(".").lower() if match else ""
    keys = set()
    if host:
        parts = host.split(".")
        keys |= {".".join(parts[i:]) for i in range(len(parts))}
        path = [p for p in match[2].split("/") if p]
        keys |= {host + "/" + "/".join(path[: i + 1]) for i in range(len(path))}
    held = set()
    for name, key in {(e[0], (e[1] or "").lower()) for e in entries}:
        events = sorted((e[3], e[2] == "add") for e in entries if e[0] == name and (e[1] or "").lower() == key and e[3] and e[2] in ("add", "remove"))
        past = [a for d, a in events if day and d <= day]
        if key in keys and past and past[-1]:
            held.add((name, key))
    lists = {n for n, _ in held}
    return "block" in lists and "allow" not in lists, "allow" in lists, len(held), ",".join(sorted(f"{n}:{k}" for n, k in held))


def test_url_lists(spark):
    d = lambda n: date(2024, 1, n)
    entries = [
        ("block", "spam.example.com", "add", d(3)), ("block", "spam.example.com", "remove", d(10)), ("block", "spam.example.com", "add", d(20)),
        ("block", "Example.org", "add", d(5)), ("allow", "good.example.org", "add", d(7)), ("allow", "good.example.org", "remove", d(9)),
        ("block", "site.net/bad", "add", d(1)), ("block", "site.net/bad", "add", d(2)), ("block", "site.net/bad", "remove", d(2)), ("block", "x.net", "remove", d(2)),
        ("block", None, "add", d(1)), ("block", "y.net", None, d(1)), ("block", "y.net", "add", None), ("block", "com", "add", d(28)),
    ]
    urls = ["https://spam.example.com/a", "http://www.SPAM.example.com:8080/x?q=1", "https://user:pw@good.example.org./p", "https://bad.example.org", "https://site.net/bad/page#f", "https://site.net/badly", "https://x.net/", "https://y.net", None, "", "no url", "ftp://site.net//bad", "https://notspam.example.com"]
    captures = [(i, u, d(n)) for i, u in enumerate(urls) for n in range(1, 31)] + [(100, urls[0], None)]
    table = spark.createDataFrame(captures, "page_id long, url string, day date")
    rows = url_lists.evaluate(table.unionAll(table.limit(5)), spark.createDataFrame(entries, "list string, key string, action string, day date")).collect()
    expected = {(i, day): plain_url_verdict(u, day, entries) for i, u, day in captures}
    assert {(r.page_id, r.day): (r.blocked, r.allowed, r.n_entries, r.entries) for r in rows} == expected and len(rows) == len(captures)
    assert any(r.blocked for r in rows) and any(r.allowed for r in rows)
    assert url_lists.evaluate(table.limit(0), spark.createDataFrame(entries, "list string, key string, action string, day date")).count() == 0


def test_url_lists_use_no_python(spark):
    pages = spark.createDataFrame([(1, "https://a.b/c", date(2024, 1, 1))], "page_id long, url string, day date")
    plan = url_lists.evaluate(pages, url_lists.demo_entries(pages))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- WARC ------------------------------------------------------------------------------------------------------------


def test_warc(spark, monkeypatch):
    body = "<p>" + "same text " * 20 + "</p>"
    pages = [(5, "http://a/1", body), (3, "http://a/2 x", body), (9, None, body), (1, "http://b", "short"), (2, "http://b", "short"), (7, "u", None), (8, "u", ""), (11, "http://é/日", "é" * 60), (12, "x", "é" * 60), (13, "y", "e" * 99), (14, "y", "e" * 99), (15, "z", "long " * 50_000)]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, file string").repartition(2)
    index = warc.write_archives(table, new_path(spark, "w"))
    first: dict[str, int] = {}
    for i, _, h in sorted(pages):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    for gap in (warc.GAP, 0):
        monkeypatch.setattr(warc, "GAP", gap)
        rows = warc.read_archives(index).collect()
        assert len(rows) == len(pages)
        for r in rows:
            html = next(h for i, _, h in pages if i == r.page_id) or ""
            data = html.encode()
            other = first.get(html, r.page_id)
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
            assert (r.record_type, r.refers_to) == (("response", None) if other == r.page_id else ("revisit", other))
            assert r.html == (html if other == r.page_id else None)
    some = warc.read_archives(index.filter("page_id in (3, 11)")).collect()
    assert sorted(r.page_id for r in some) == [3, 11]
    assert warc.archive_pages(table.limit(0), spark).count() == 0


def test_archives_are_gzip_members(spark):
    import gzip

    index = warc.write_archives(spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(20)], "page_id long, url string, html string").coalesce(1), new_path(spark, "w")).collect()
    data = open(index[0].file.removeprefix("file://"), "rb").read()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 20
    for r in index:
        head, block = warc.parse(gzip.decompress(data[r.offset : r.offset + r.length]))
        assert head["WARC-Target-URI"] == r.url and block == f"<p>{r.page_id}</p>".encode()


def test_ranges_cover_and_coalesce():
    rows = [(0, 10), (10, 5), (20, 5), (200_000, 10), (200_010, 20 << 20)]
    found = list(warc._ranges(rows))
    assert [(i, j) for i, j, *_ in found] == [(0, 3), (3, 4), (4, 5)] and found[0][2:] == (0, 25)


# --- HTML ------------------------------------------------------------------------------------------------------------


def test_blocks():
    page = '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a><li>About</ul></nav><!-- <p>no</p> --><article><h1>Big &amp; small</h1><p><b>One<br>two<p>Three  \n four</p>loose<table><tr><td>c1<td>c2</table></article><p title="a>b">end &lt;3'
    found = blocks(page)
    assert [b.text for b in found] == ["Home", "About", "Big & small", "One two", "Three four", "loose", "c1", "c2", "end <3"]
    assert found[0].link_share == 1 and found[3].link_share == 0 and found[0].path != found[2].path
    assert blocks("") == []
    assert [b.text for b in blocks("a < b <!-- never closed")] == ["a < b"]


def test_gradients_are_right():
    pages = [html_extraction.labelled_page(s) for s in (1, 2)]
    labeller = html_extraction.Labeller.fresh()
    targets = np.zeros((max(len(b) for b, _ in pages), 2))
    for k, (b, y) in enumerate(pages):
        targets[: len(b), k] = y

    def loss():
        total = n = 0
        for (b, y), p in zip(pages, labeller.scores([b for b, _ in pages])):
            total -= (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
            n += len(b)
        return total / n

    gradients = labeller._gradients([b for b, _ in pages], targets)
    r = np.random.default_rng(0)
    for name, g in gradients.items():
        for flat in r.choice(np.flatnonzero(g), min(4, np.count_nonzero(g)), replace=False):
            at = np.unravel_index(flat, g.shape)
            kept = labeller.p[name][at]
            labeller.p[name][at] = kept + 1e-5
            up = loss()
            labeller.p[name][at] = kept - 1e-5
            down = loss()
            labeller.p[name][at] = kept
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name


def test_labeller_on_unseen_pages():
    wrong = n = 0
    for seed in range(50_000, 50_120):
        found, y = html_extraction.labelled_page(seed)
        if found:
            wrong += int(((html_extraction.trained().scores([found])[0] >= 0.5) != y).sum())
            n += len(y)
    assert wrong / n < 0.01


def test_extraction_of_pages(spark):
    import html as html_

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(-1, "u", None), (-2, "u", ""), (-3, "u", "no markup at all"), (-4, "u", "<nav><a href=x>Home</a></nav>"), (-5, "u", "<")], "page_id long, url string, html string")
    rows = {r.page_id: r.main for r in html_extraction.extract(pages.unionByName(odd), keep=["page_id"]).select("row.page_id", "out.main").collect()}
    assert rows[-1] == rows[-2] == rows[-4] == "" and len(rows) == pages.count() + 5
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html_.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert rows[r.page_id] == "\n\n".join(p for p in parts if p)
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_pairs_of_long_unexplained_texts_stay_small():
    import resource
    import time

    r = np.random.default_rng(2)
    rows = [np.sort(r.choice(6000, 4000, replace=False)).astype(np.int64) for _ in range(60)]
    labels = np.r_[np.ones(30), np.zeros(30)]
    flat, of = np.concatenate(rows), np.repeat(np.arange(60), 4000)
    seen = np.bincount(flat, minlength=6000).astype(float)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    found = toxicity._pair_terms(flat, of, np.ones(6000, bool), seen, labels, labels.astype(bool))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000 and time.perf_counter() - began < 60
    # the same pairs one by one, for some first terms
    sets, rate = [set(x.tolist()) for x in rows], 0.5
    expected = set()
    for x in range(0, 6000, 1500):
        for y in range(x + 1, 6000):
            both = [k for k in range(60) if x in sets[k] and y in sets[k]]
            inside = sum(k < 30 for k in both)
            if inside >= toxicity.PAIR_TEXTS and inside >= toxicity.PAIR_LIFT * 30 * seen[x] * seen[y] / 3600 and toxicity._chi2(float(inside), float(len(both)), rate) >= toxicity.PAIR_CHI2:
                expected |= {x, y}
    assert all(found[t] for t in expected)

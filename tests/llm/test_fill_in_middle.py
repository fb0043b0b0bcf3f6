"""Fill-in-middle: exact round trips, and cuts against whole texts."""

import hashlib
import re

from conftest import *  # noqa: F403
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.llm import fill_in_middle as M


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return len(lines), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text("ab\n<é日𝕏PSM>", max_size=60), st.integers(0, 50), st.integers(1, 9))
def test_round_trip_at_any_frame_size(text, doc_id, size):
    raw = text.encode()
    stored = M.Frames.of([raw], size)
    assert b"".join(stored.stream()) == raw and stored.chars[-1] == len(text)
    marked = any(m in raw for m in (M.PREFIX, M.SUFFIX, M.MIDDLE))
    output, form, n, prefix, middle = M.transformed(stored, doc_id, 7, 100, 50, marked, size)
    expected = plain(doc_id, text)
    assert (n, form, prefix, middle, b"".join(output.stream()).decode()) == expected
    assert output.digest() == hashlib.sha256(expected[4].encode()).hexdigest()
    assert output.digest(*M.ranges(output, form)) == hashlib.sha256(raw).hexdigest()


def test_only_the_frames_of_the_cuts_are_read():
    lines = [f"line {k}\n".encode() for k in range(50_000)]
    stored = M.Frames.of([b"".join(lines)], 4096)
    read = []
    frame = M.Frames.frame
    try:
        M.Frames.frame = lambda self, k: (read.append(k), frame(self, k))[1]
        at, chars = stored.after_lines(31_234)
    finally:
        M.Frames.frame = frame
    assert at == chars == sum(map(len, lines[:31_234])) and len(set(read)) == 1 and len(stored.data) > 100


def test_operator(spark, docs, no_docs):
    odd = docs.select("*", *(F.lit("clash").alias(c) for c in ("id", "marked", "output", "n", "form", "_present"))).unionByName(
        docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one <S> marker\n").alias("text"), *(c for c in docs.columns if c not in ("doc_id", "text"))), allowMissingColumns=True
    )
    for frame_bytes in (M.FRAME_BYTES, 100):
        made = M.transform(M.store(odd, frame_bytes=frame_bytes), frame_bytes=frame_bytes)
        texts = sorted((str(r.doc_id), r.text or "") for r in odd.collect())
        assert sorted((str(r.row.doc_id), r.text) for r in M.restored_texts(made).collect()) == texts
        got = sorted((str(r.row.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in M.digests(made).collect())
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got == sorted((str(r.doc_id), *(p := plain(r.doc_id, r.text))[:4], sha(p[4]), sha(r.text or "")) for r in odd.collect())
    assert M.digests(M.fill_in_middle(no_docs)).count() == 0

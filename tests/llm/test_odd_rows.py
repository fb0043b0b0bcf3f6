"""All operators and stages over rows without ids, repeated rows, and extra columns named like those inside."""

import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from ragloom.llm import decontamination, html_extraction, jaccard_join, packing, quality, token_counts, token_files, toxicity, url_lists, warc
from ragloom.llm.common import new_path

#: Names of columns inside the operators.
INSIDE = """_id _id_ _0 _html _text _order _present _salt a apart b body bucket bucket_id cells chunk comp component_id count day digest df doc_id2 entries first found h hashes host hs id ids
ids_crc32 item items key kind kept label lang_id length level m members n n_shingles n_tokens n_words named node offset out part parts path perplexity piece pivot role row score sequence_id shared sig size start values""".split()
LEFT = [(None, "one two three four five six seven", "en"), (None, None, None), (7, "one two three four five six seven", "en"), (7, "one two three four five six seven", "en"), (8, "one two three four five six seven eight", None)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(LEFT, "doc_id long, text string, lang string")
    return rows.select("*", *(F.lit("clash").alias(c) for c in INSIDE)).repartition(2)


def test_operators(spark, odd):
    n = len(LEFT)
    labels = spark.createDataFrame([(7, 1, "x"), (8, 0, "x"), (None, 1, "x")], "doc_id long, toxic int, label string")
    bench = spark.createDataFrame([(None, "two three four", "x"), (1, "seven eight", "x"), (None, None, "x")], "item_id long, text string, item string")
    assert sorted((str(r.doc_id), r.n_bytes) for r in token_counts.count_tokens(odd).collect()) == sorted((str(i), len(t or "")) for i, t, _ in LEFT)
    assert sorted(str(r.component_id) for r in jaccard_join.join(odd).collect()) == ["7", "7", "8", "None", "None"]
    manifest = token_files.write_tokens(odd, new_path(spark, "odd"))
    assert token_files.digests(manifest).count() == n
    hits = decontamination.find_contamination(odd, bench).select("*", decontamination.n_hit().alias("n_hit")).collect()
    found = {(r.row.doc_id, r.text): (r.n_hit, r.out["items"]) for r in hits}
    assert len(hits) == n
    assert found[8, LEFT[-1][1]] == (5, ["1", None]) and found[7, LEFT[2][1]] == (3, [None]) and found[None, None] == (0, [])
    judged = quality.judge(odd).collect()
    assert len(judged) == n and all(r.base_failed and r.row.perplexity == "clash" for r in judged)
    scored = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(scored) == n and all(0 <= r.out.score <= 1 and r.row.label == "clash" for r in scored)
    packed = packing.pack_documents(odd).collect()
    assert len(packed) == n and sum(r.doc_id is None for r in packed) == 2


def test_operators_over_pages(spark):
    html = "<html><body><article><p>" + "Some words of a page. " * 9 + "</p></article></body></html>"
    rows = [(None, "http://a.com/x", html), (None, None, html), (3, "http://a.com/x", html), (3, "http://a.com/x", html), (5, "http://b.com", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("clash").alias(c) for c in INSIDE if c not in ("day",)))
    read = warc.archive_pages(pages, spark).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in read) == [("3", "response", None)] * 2 + [("5", "response", None)] + [("None", "response", None)] * 2
    assert html_extraction.extract(pages).count() == len(rows)
    captures = pages.withColumn("day", F.lit("2024-02-01").cast("date"))
    assert {str(r.page_id) for r in url_lists.evaluate(captures.select("page_id", "url", "day"), url_lists.demo_entries(pages.select("page_id", "url"))).collect()} == {"None", "3", "5"}


def test_stages(spark, odd):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == odd.columns, name
        assert all(r._id == r.label == r.cells == "clash" for r in out.collect()), name
    assert corpus_pipeline.pack_sequences(spark, odd, "/root/testdata/sf0.001").count() == len(LEFT)

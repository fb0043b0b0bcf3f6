"""Cases that a review found: capitals in listed paths."""

from datetime import date

from pyspark.sql import functions as F

from ragloom.llm import url_lists


def test_path_of_an_entry_keeps_its_case(spark):
    entries = spark.createDataFrame([("block", "Example.com/News", "add", date(2024, 1, 1))], "list string, key string, action string, day date")
    urls = ["http://example.com/News/1", "http://EXAMPLE.com/news/1", "http://example.com/News"]
    captures = spark.createDataFrame([(i, u, date(2024, 1, 2)) for i, u in enumerate(urls)], "page_id long, url string, day date")
    rows = {r.page_id: (r.blocked, r.entries) for r in url_lists.evaluate(captures, entries).collect()}
    assert rows == {0: (True, "block:example.com/News"), 1: (False, ""), 2: (True, "block:example.com/News")}
    keys = spark.createDataFrame([("A.b",), ("A.b/",), ("A/B\nC",), (None,)], "key string")
    assert [r.k for r in keys.select(url_lists.entry_key(F.col("key")).alias("k")).collect()] == ["a.b", "a.b/", "a/B\nC", None]

"""The stored corpus and the stream that fills it: buckets, versions, writers that meet, changed files, restarts, failures."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from ragloom.operators import corpus
from ragloom.operators.storage import Conflict, CorpusTable
from ragloom.streaming import directory, files

FIELDS = "id string, document string, metadata string, embedding array<float>, position long"


def rows(spark, made):
    return spark.createDataFrame([(i, t, json.dumps({"relative_path": p, "source": p, "content_kind": "x", "nested": {"page": "no"}, "page": 3, "slide": True}), None, k) for k, (i, t, p) in enumerate(made)], FIELDS)


def the_files(spark, names):
    return spark.createDataFrame([(n, n) for n in names], "relative_path string, source string")


def state(table, version=None):
    return {r.id: (r.document, r.row_seq) for r in table.read(version).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = CorpusTable(spark, str(tmp_path / "corpus"), buckets=8)
    assert table.read().count() == 0 and table.version() == 0
    table.replace_files(rows(spark, [(f"{n}{k}", "text " * 200, n) for n in "abcdefgh" for k in range(30)]), the_files(spark, "abcdefgh"))
    all_bytes = table.bytes_written
    first = state(table)
    assert sorted(n for _, n in first.values()) == list(range(1, 241))
    table.replace_files(rows(spark, [("a1", "new", "a"), ("a99", "newer", "a")]), the_files(spark, "a"))
    assert table.bytes_written < all_bytes / 2
    now = state(table)
    assert {i for i in now if i[0] == "a"} == {"a1", "a99"} and len(now) == 212 and sorted(n for i, (_, n) in now.items() if i[0] == "a") == [241, 242]
    assert state(table, 1) == first  # old versions stay whole
    table.upsert(rows(spark, [("b1", "changed", "b"), ("z", "added", "zz")]))
    after = state(table)
    assert after["b1"] == ("changed", first["b1"][1]) and after["z"] == ("added", 243) and len(after) == 213
    table.delete(source="b")
    assert len(state(table)) == 183
    assert table.expire(1) and table.versions.numbers() == [4] and len(state(table)) == 183
    plan = table.read().filter("content_kind = 'y'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(content_kind,y)" in plan and "document" not in plan.split("ReadSchema")[1]
    one = table.read().first()
    assert (one.page, one.slide, one.content_kind) == ("3", None, "x")  # a number, a boolean, and no other key of that name


def test_a_second_writer_loses_nothing(spark, tmp_path):
    one, two = (CorpusTable(spark, str(tmp_path / "corpus")) for _ in range(2))
    one.replace_files(rows(spark, [("a", "one", "a")]), the_files(spark, "a"))
    commit = two.versions.commit

    def late(number, content):  # the other writer is first
        two.versions.commit = commit
        one.replace_files(rows(spark, [("b", "two", "b")]), the_files(spark, "b"))
        return commit(number, content)

    two.versions.commit = late
    with pytest.raises(Conflict):
        two.replace_files(rows(spark, [("c", "three", "c")]), the_files(spark, "c"))
    assert set(state(two)) == {"a", "b"}
    two.replace_files(rows(spark, [("c", "three", "c")]), the_files(spark, "c"), batch=("s", 1))
    assert set(state(one)) == {"a", "b", "c"}
    number = two.replace_files(rows(spark, [("d", "four", "c")]), the_files(spark, "c"), batch=("s", 1))
    assert number == 3 and set(state(one)) == {"a", "b", "c"}  # that batch is in


def put(path, text, at):
    path.write_text(text)
    os.utime(path, (at, at))


def test_changed_files_come_again_and_restarts_lose_nothing(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "deeper").mkdir()
    past = time.time() - 1000
    put(folder / "a.txt", "first text", past)
    put(folder / "b.csv", "Name,Age\nAn,4\nBinh,\n", past)
    put(folder / "broken.docx", "no archive", past)
    put(folder / "other.bin", "x", past)
    put(folder / "young.txt", "still written", time.time() + 100)
    table = CorpusTable(spark, str(tmp_path / "corpus"), buckets=4)
    calls = []

    def prepare(batch):
        calls.append(sorted(r.path.rsplit("/", 1)[1] for r in batch.select("path").collect()))
        return files.prepared(batch, size=40, overlap=5)

    def run():
        stream = directory.read_changes(spark, str(folder), str(tmp_path / "snapshots"), settle=5)
        files.ingest_stream(stream, table, prepare, str(tmp_path / "checkpoint"), most=1, wait=0.01).awaitTermination(180)
        return {(r.source, r.chunk_index): r.document for r in table.read().collect()}

    expected = {("a.txt", "0"): "first text", ("b.csv", "0"): "Name: An, Age: 4", ("b.csv", "1"): "Name: Binh"}
    assert run() == expected
    assert calls == [["a.txt", "b.csv", "broken.docx", "other.bin"], ["broken.docx"]]  # the broken one again
    failures = spark.read.parquet(f"{table.path}/failures").collect()
    assert [r.path.rsplit("/", 1)[1] for r in failures] == ["broken.docx"] and "BadZipFile" in failures[0].error
    ids = {r.id for r in table.read().collect()}
    put(folder / "a.txt", "second text " * 5, past + 50)
    put(folder / "c.md", "more", past)
    (folder / "b.csv").unlink()
    found = run()
    assert calls[2:] == [["a.txt", "c.md"]]  # changed and new ones alone
    assert found[("c.md", "0")] == "more" and found[("b.csv", "1")] == "Name: Binh"  # files that are gone keep their chunks
    assert found[("a.txt", "0")].startswith("second") and ("a.txt", "1") in found and len({r.id for r in table.read().collect()} & ids) == 2
    vectors = table.read().select(F.size("embedding").alias("n")).distinct().collect()
    assert [r.n for r in vectors] == [64]
    # a stop after the table was written and before the stream knew of it: the batch is made again and changes nothing
    before, commits = table.version(), tmp_path / "checkpoint" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    for kept in (tmp_path / "snapshots").iterdir():
        assert kept.name.endswith(".json")
    assert run() == found and table.version() == before


def test_an_engine_that_raises_is_an_error_row(spark, tmp_path):
    def raising(content, name):
        yield "before", {"source": name}
        raise IndexError("of the engine")

    (tmp_path / "x.pdf").write_bytes(b"1")
    batch = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("modificationTime").alias("modified"), "length", "content")
    out = files.prepared(batch, {"pdf": raising}).collect()
    assert [(r.source, r.error, r.document) for r in out] == [("x.pdf", "IndexError: of the engine", "before")]


def test_numbers_of_ranges_are_unique(spark):
    many = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") % 7).alias("at")).repartition(5)
    numbers = sorted(r.number for r in corpus.numbered(many, "at", "id").collect())
    assert numbers == list(range(1, 5001))

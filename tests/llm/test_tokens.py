"""Token counts, token files and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import *  # noqa: F403
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragloom.llm import bpe_units, packing, token_counts, token_files
from ragloom.llm.common import new_path

BYTES, WORDS_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    r = random.Random(1)
    alphabet = " \n\t  abZ1'.-é́İ<|\x1c\x85᠎日"
    fixed = ["", " ", "  ", "a  b", "a \n b", "a\n  b", " a", "a \n \n b", "x <|endoftext|> y", "don't  I'll", "½²³ 12a", "a  b  c", "ſs 's 'S X'LL", "thnt, thnt. thnt! 'a, b1. é,"]
    return fixed + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 14))) for _ in range(4000)]


def test_counts_are_the_librarys():
    library = Tokenizer.from_file(WORDS_FILE)
    counter = token_counts.Counter(WORDS_FILE, token_counts.prove_whole_tokens(WORDS_FILE))
    texts = odd_texts()
    for _ in range(2):  # the second time from memory
        assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_code_point_of_the_agreed_range():
    library = Tokenizer.from_file(WORDS_FILE)
    counter = token_counts.Counter(WORDS_FILE, token_counts.prove_whole_tokens(WORDS_FILE))
    texts = [f"a{c}b 1{c}{c}" for c in map(chr, range(1, 0x3000)) if token_counts._AGREED.fullmatch(c)]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_proven_strings_are_one_token():
    library = Tokenizer.from_file(WORDS_FILE)
    proven = token_counts.prove_whole_tokens(WORDS_FILE)
    assert len(proven) > 20_000
    for text in random.Random(2).sample(sorted(proven), 500):
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_ids_are_the_librarys(monkeypatch):
    library = Tokenizer.from_file(BYTES)
    texts = odd_texts() + ["".join(f" {w}" for w in odd_texts()[:300])]
    for size in (1 << 20, 40):  # also in slices
        monkeypatch.setattr(bpe_units, "SLICE_CHARS", size)
        encoder = bpe_units.Encoder(BYTES)
        for _ in range(2):
            assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cuts_are_the_patterns(monkeypatch):
    library = Tokenizer.from_file(BYTES)
    r = random.Random(5)
    alphabets = [" \n ab'stmdrevl.1", " \naé×÷ɏɐ¡\xa0ſ'sZ0", "<|endoftext|> \n'", "  \n\n\n a.", "aß÷×ÀÖØöøɏɐÿ \n,ʼ²½ª"]
    texts = ["", *("".join(r.choice(a) for _ in range(r.randrange(16))) for a in alphabets for _ in range(1500)), "a<|endoftext|>b <|endoftext|>"]
    texts += [" ".join(f"{c}x{c} y{c}z" for c in map(chr, range(k, k + 64))) for k in range(1, 0x3000, 64)]
    for size in (1 << 20, 3):
        monkeypatch.setattr(bpe_units, "SLICE_CHARS", size)
        ids, ends = bpe_units.Encoder(BYTES).encode_column(pa.array([None, *texts]).slice(1), 7)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_each_pre_token_is_encoded_once():
    library = Tokenizer.from_file(BYTES)
    encoder = bpe_units.Encoder(BYTES)
    encoder.encode([" thnt qorly, qorly.\nThnt's &&& x"])
    encoder.library = encoder.bare = None  # nothing is left to ask
    text = " qorly thnt's.\nThnt qorly &&& qorly,\nThnt x's qorly.\nThnt, &&& thnt"
    assert np.frombuffer(encoder.encode([text])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_remembered_parts_are_pre_tokens():
    encoder = bpe_units.Encoder(BYTES)
    encoder.encode([f"so a{i}.\nB{k}, as" for i in range(30) for k in range(30)])
    assert len(encoder.units) < 50  # not one for each of the pairs


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_units, "REMEMBERED_UNITS", 50)
    encoder = bpe_units.Encoder(BYTES)
    for i in range(20):
        encoder.encode([" ".join(f"w{i}x{k}" for k in range(40))])
        assert len(encoder.units) <= 130


def test_count_tokens(docs, no_docs):
    library = Tokenizer.from_file(WORDS_FILE)
    rows = token_counts.count_tokens(docs).collect()
    assert len(rows) == len(ROWS)  # noqa: F405
    text = {r[0]: r[1] or "" for r in ROWS}  # noqa: F405
    for r in rows:
        n = len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)
    assert token_counts.count_tokens(no_docs).count() == 0


def test_token_files(spark, docs, no_docs):
    library = Tokenizer.from_file(BYTES)
    manifest = token_files.write_tokens(docs, new_path(spark, "t"))
    rows = sorted(token_files.digests(manifest).collect(), key=lambda r: r.start)
    expected = sorted(((r[0], r[1] or "") for r in ROWS))  # noqa: F405
    assert [r.doc_id for r in rows] == [i for i, _ in expected]
    start = 0
    for r, (_, text) in zip(rows, expected, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read_tokens(manifest, low=5, high=8).collect()
    assert sorted(r.doc_id for r in some) == [5, 6, 7, 8]
    assert all(r.ids == library.encode(dict(expected)[r.doc_id], add_special_tokens=False).ids + [0] for r in some)
    assert token_files.read_tokens(manifest, with_ids=False).columns == ["doc_id", "start", "n_tokens"]
    assert token_files.digests(token_files.write_tokens(no_docs, new_path(spark, "t"))).count() == 0


def test_files_have_the_promised_format(spark, docs):
    import pyarrow.parquet as pq

    path = token_files.write_tokens(docs, new_path(spark, "t")).first().file
    column = pq.ParquetFile(path.removeprefix("file://")).metadata.row_group(0)
    by_name = {column.column(k).path_in_schema: column.column(k) for k in range(column.num_columns)}
    assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in by_name["n_tokens"].encodings
    assert by_name["doc_id"].has_column_index and by_name["ids.list.element"].has_offset_index


def test_a_range_reads_few_pages(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id"), F.md5(F.col("id").cast("string"))).alias("text")).coalesce(1)
    manifest = token_files.write_tokens(many, new_path(spark, "pages"))
    whole = {r.doc_id: (r.start, r.ids) for r in token_files.read_tokens(manifest).filter("doc_id between 9990 and 10009").collect()}
    some = token_files.read_tokens(manifest, low=9990, high=10009)
    assert {r.doc_id: (r.start, r.ids) for r in some.collect()} == whole and len(whole) == 20

    noted = []
    plan = some._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet") and "ids" in node.schema().simpleString():
            noted.append(node.metrics().apply("numOutputRows").value())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 20 <= sum(noted) <= 3 * token_files.PAGE_ROWS, noted


@pytest.mark.parametrize("open_bins", [1, 3, 64])
def test_packer_is_best_fit(open_bins):
    r = random.Random(open_bins)
    packer = packing.Packer(100, open_bins)
    free: list[int] = []
    used: dict[int, int] = {}
    for _ in range(3000):
        n = r.randint(1, 100)
        bin_, offset = packer.place(n)
        fitting = [f for f in free if f >= n]
        if fitting:
            best = min(fitting)
            free.remove(best)
        else:
            if len(free) >= open_bins:
                free.remove(min(free))
            best = 100
        assert offset == 100 - best == used.get(bin_, 0)
        used[bin_] = offset + n
        if best > n:
            free.append(best - n)
        assert sorted(free) == sorted(f for f, bins in enumerate(packer.by_free) for _ in bins)


def test_pack_documents(docs, no_docs):
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack_documents(docs, with_ids=True).collect()
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for of in by_sequence.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    single = [r for r in rows if r.doc_id != 12]
    for i, text, *_ in ROWS:  # noqa: F405
        if i == 12:
            continue
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in single if r.doc_id == i), key=lambda r: r.piece)
        assert [t for r in mine for t in r.ids] == ids and [r.piece for r in mine] == list(range(len(mine)))
        assert all(r.length == 1024 for r in mine[1:]) and (len(ids) > 1024 or len(mine) == 1)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == sum(q.length for q in mine[: r.piece]) for r in mine)
    assert sum(r.doc_id == 12 for r in rows) == 2
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_is_dense(spark):
    r = random.Random(4)
    items = spark.createDataFrame([(i, 0, 0, bytes(4 * r.randint(1, 1024))) for i in range(20_000)], "doc_id long, piece int, start long, ids binary")
    sequences = packing.written(packing.pack(items), "dense")
    placed = packing.places(sequences)
    assert sequences.filter("octet_length(ids) <> 4 * aggregate(parts.length, 0, (n, x) -> n + x) or octet_length(ids) > 4096").count() == 0 and placed.count() == 20_000
    total = placed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert total[1] <= 1.03 * total[0] / 1024

"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_in_middle, html_extraction, jaccard_join, license_scan, quality, spelling_variants, toxicity, url_lists, warc
from .common import new_path, table
from .oracles import ORACLE_SQL  # noqa: F401
from .packing import pack_documents
from .token_counts import count_tokens
from .token_files import digests, write_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return url_lists.evaluate(captures, url_lists.demo_entries(pages)).withColumn("day", F.col("day").cast("string"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-files")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "out.n_words",
        decontamination.n_hit().alias("n_hit"),
        F.size("out.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("out.items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", F.col("out.main").alias("text"), F.length("out.main").cast("long").alias("n_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [f"out.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("row.doc_id", *counts, "base_failed", "kept", "perplexity")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine, keep=["doc_id"])
    held_out = F.pmod(F.crc32(F.col("row.doc_id").cast("string")), F.lit(4)) == 2
    return scored.select("row.doc_id", held_out.alias("held_out"), "out.score", (F.col("out.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"), spark)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.count_words(table(spark, sf_dir, "documents"), slip_every=199))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [f"out.{c}" for c in ("n_words", "n_base", "first_word", "last_word")]
    return found.select("row.doc_id", *counts, F.array_join("out.base_labels", ",").alias("base_labels"), F.array_join("out.labels", ",").alias("labels"), "out.score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return fill_in_middle.digests(made).select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_url_lists,
        op3_jaccard_join,
        op4_token_files,
        op5_decontamination,
        op6_html_extraction,
        op7_quality_rules,
        op8_toxicity,
        op9_warc,
        op10_best_fit_packing,
        op11_spelling_variants,
        op12_license_scan,
        op13_fill_in_middle,
    )
}

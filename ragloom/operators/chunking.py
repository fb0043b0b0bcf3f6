"""Chunks of files: splitting, numbering, line caps over chunks, tabular rendering, near-duplicate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import chunks, filled_lines, fold, is_blank, lines, trim_space, useful_line

from .versions import stable

UNSPLIT = ("csv", "xlsx")


def split_documents(docs: DataFrame, size: int = 600, overlap: int = 100, text: str = "document", whole: Column | None = None) -> DataFrame:
    """``docs`` with ``chunk_no`` from 0 and ``chunk``, a row for each chunk; rows for which ``whole`` holds are one chunk each."""
    parts = chunks(F.col(text), size, overlap)
    if whole is not None:
        parts = F.when(whole, F.filter(F.array(F.col(text)), lambda t: ~is_blank(t))).otherwise(parts)
    return docs.select("*", F.posexplode(parts).alias("chunk_no", "chunk"))


def number_chunks(pieces: DataFrame, file: str = "path", order: tuple[str, ...] = ("doc_no", "chunk_no")) -> DataFrame:
    """``chunk_index`` from 0 through all documents of a file."""
    return pieces.withColumn("chunk_index", F.row_number().over(Window.partitionBy(file).orderBy(*order)) - 1)


def cap_lines(pieces: DataFrame, scope: str, order: str, key: str, text: str = "document", most: int = 2) -> DataFrame:
    """Useful lines of the chunks of a scope, each folded line ``most`` times in all, in order: ``scope, key, cleaned``.

    A chunk that loses all its lines has an empty text. Long scopes sort on disk; only lines of equal text meet.
    """
    split = pieces.select(scope, order, key, F.posexplode(F.transform(lines(F.coalesce(F.col(text), F.lit(""))), trim_space)).alias("pos", "line"))
    ranked = split.filter(useful_line(F.col("line"))).withColumn("n", F.row_number().over(Window.partitionBy(scope, fold(F.col("line"))).orderBy(order, key, "pos")))
    cleaned = ranked.filter(F.col("n") <= most).groupBy(scope, key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("cleaned"))
    return pieces.select(scope, key).join(cleaned, [scope, key], "left").select(scope, key, F.coalesce("cleaned", F.lit("")).alias("cleaned"))


def render_row(columns: list[tuple[str, Column]]) -> Column:
    """``name: value, name: value`` of a row, blank values left out; null if all are blank."""
    parts = F.array_compact(F.array(*(F.when(~is_blank(value), F.concat(F.lit(f"{name}: "), trim_space(value))) for name, value in columns)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))


def line_set(text: Column) -> Column:
    """Distinct folded lines, without the headers of slides."""
    body = F.filter(filled_lines(F.coalesce(text, F.lit(""))), lambda line: ~(line.startswith("[SLIDE:") | line.startswith("[VĂN BẢN")))
    return F.array_distinct(F.transform(body, fold))


def near_duplicate_pairs(pieces: DataFrame, scope: str = "source", key: str = "id", text: str = "document", least_lines: int = 4, ratio: float = 0.8) -> DataFrame:
    """``scope, a, b, shared, n, m``: pairs of chunks of a scope with equal lines, at least ``ratio`` of the larger set.

    Found through lines: a pair meets at the rare lines that it must share (the rest of its lines, in order of how many chunks have
    them, cannot hold all shared ones), so a line that all chunks have makes no pairs by itself. Sizes decide before sets are compared.
    """
    sets = pieces.select(scope, key, line_set(F.col(text)).alias("lines")).withColumn("n", F.size("lines")).filter(F.col("n") >= least_lines)
    entries = sets.select(scope, key, "n", F.explode("lines").alias("line"))
    df = entries.groupBy(scope, "line").agg(F.count("*").alias("df"))
    ranked = entries.join(df, [scope, "line"]).withColumn("pos", F.row_number().over(Window.partitionBy(scope, key).orderBy("df", "line")))
    needed = ranked.filter((F.col("df") > 1) & (F.col("pos") <= F.col("n") - F.ceil(F.col("n") * ratio - 1e-9) + 1)).select(scope, key, "n", "line")
    a = needed.select(scope, "line", F.col(key).alias("a"), F.col("n").alias("n"))
    b = needed.select(scope, "line", F.col(key).alias("b"), F.col("n").alias("m"))
    pairs = a.join(b, [scope, "line"]).filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * ratio - 1e-9)).select(scope, "a", "b", "n", "m").distinct()
    left = sets.select(scope, F.col(key).alias("a"), F.col("lines").alias("la"))
    right = sets.select(scope, F.col(key).alias("b"), F.col("lines").alias("lb"))
    both = pairs.join(left, [scope, "a"]).join(right, [scope, "b"]).withColumn("shared", F.size(F.array_intersect("la", "lb")))
    return both.filter(F.col("shared") >= F.greatest("n", "m") * ratio - 1e-9).select(scope, "a", "b", "shared", "n", "m")


def near_duplicate_classes(pieces: DataFrame, scope: str = "source", key: str = "id", text: str = "document", least_lines: int = 4) -> DataFrame:
    """``scope, key, class_key, n_lines``: chunks of a scope with equal sets of lines, ``least_lines`` or more, are one class, named by its smallest key."""
    sets = pieces.select(scope, key, F.array_sort(line_set(F.col(text))).alias("lines")).filter(F.size("lines") >= least_lines)
    digest = F.sha2(F.array_join("lines", "\n"), 256)  # a line holds no line end
    slim = sets.select(scope, key, F.size("lines").alias("n_lines"), digest.alias("digest"))
    firsts = slim.groupBy(scope, "digest").agg(F.min(key).alias("class_key"))
    return slim.join(firsts, [scope, "digest"]).select(scope, key, "class_key", "n_lines")


def near_duplicate_links(pieces: DataFrame, scope: str = "source", key: str = "id", text: str = "document", least_lines: int = 4, ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The classes of :func:`near_duplicate_classes`, and the links between them: ``scope, a, b, shared, n, m``.

    A class links by its first chunk, so many equal chunks are one row for each and no pair among them. The pairs of all chunks are those of linked classes and
    those within a class; :func:`expanded` gives them.
    """
    classes = stable(near_duplicate_classes(pieces, scope, key, text, least_lines), "line-classes")
    heads = pieces.join(classes.filter(F.col(key) == F.col("class_key")).select(scope, key), [scope, key], "left_semi")
    return classes, near_duplicate_pairs(heads, scope, key, text, least_lines, ratio)


def expanded(classes: DataFrame, links: DataFrame, scope: str = "source", key: str = "id") -> DataFrame:
    """``scope, a, b``: all pairs of chunks that classes and links stand for, the smaller key first. There may be very many."""
    member = classes.select(scope, "class_key", F.col(key).alias("member"))
    within = member.join(member.withColumnRenamed("member", "other"), [scope, "class_key"]).filter("member < other").select(scope, F.col("member").alias("a"), F.col("other").alias("b"))
    left, right = member.toDF(scope, "a", "x"), member.toDF(scope, "b", "y")
    across = links.select(scope, "a", "b").join(left, [scope, "a"]).join(right, [scope, "b"]).select(scope, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return within.unionByName(across)


def vision_budget(images: DataFrame, per_file: int, per_slide: int, file: str = "file", slide: str = "slide", order: str = "image_index") -> DataFrame:
    """``images`` with ``granted``: whether an eligible image is described. 0 means no limit.

    An image beyond its slide's limit takes nothing from its file's.
    """
    on_slide = F.sum(F.col("eligible").cast("int")).over(Window.partitionBy(file, slide).orderBy(order))
    passed = F.col("eligible") & (on_slide <= per_slide if per_slide else F.lit(True))
    marked = images.withColumn("_passed", passed)
    in_file = F.sum(F.col("_passed").cast("int")).over(Window.partitionBy(file).orderBy(slide, order))
    return marked.withColumn("granted", F.col("_passed") & (in_file <= per_file if per_file else F.lit(True))).drop("_passed")

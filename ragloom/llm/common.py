"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Salts of :func:`join_few`.
SALTS = 32
#: Code points after which a text is cut at a space, so that no list of its words is large.
SLICE_CHARS = 1 << 20
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; only where that is
    unset and all runs on one machine, as in tests, a temporary folder is set.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and lost executors do not matter."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ragloom_path = path
    return out


def filesystem(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_ragloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


_memories: dict[str, dict] = {}


def memory(name: str) -> dict:
    """What this process keeps from task to task under ``name``; what it kept under other names goes."""
    for other in [n for n in _memories if n != name]:
        del _memories[other]
    return _memories.setdefault(name, {})


def give_back() -> None:
    """Returns freed memory of this process to the machine, for the tasks of other processes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str | None = None, release: Callable[[], None] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``. Before each task what this process keeps under other names than ``own`` goes; after it ``release`` lets go of what the
    task held, and :func:`give_back` returns it: a process may be idle for long before it is used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [n for n in _memories if n != own]:
            del _memories[other]
        yield from function(batches)
        if release:
            release()
        give_back()

    return run


def join_few(rows: DataFrame, few: DataFrame, key: str, *by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, a table with one row for each value of ``key``.

    Spark broadcasts ``few`` if its files are below the threshold for that. Else both are shuffled, each value of ``key`` dealt by ``by``
    over :data:`SALTS` parts, since one value may hold much of ``rows``.
    """
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of integers."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64, copy=False)) * _MULTIPLY[0]
        h ^= h >> np.uint64(29)
        h *= _MULTIPLY[1]
        h ^= h >> np.uint64(32)
    return h


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Parts of ``text`` between single spaces, which are left out: ``" ".join(slices(text)) == text``."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        if cut < 0:
            cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def with_results(docs: DataFrame, text_col: str, keep: list[str], compute: Callable[..., list[pa.Array]], fields: str, extra: tuple[str | Column, ...] = (), **tidy) -> DataFrame:
    """One row ``row, text, out`` for each row of ``docs``.

    ``row`` is a struct of the columns ``keep`` but the text's own, ``text`` is the text if it is kept and
    else null, ``out`` is a struct of ``fields``. So names of columns never clash. ``compute`` gets the
    texts of a batch as bytes (null: empty) and lists of the columns ``extra``, and returns an array for each field. ``tidy`` is for :func:`tidied`.
    """
    source, schema = source_rows(docs, text_col, keep, fields, extra)
    return source.mapInArrow(tidied(computing(compute, text_col in keep, schema["out"].dataType.names, len(extra)), **tidy), schema)


def source_rows(docs: DataFrame, text_col: str, keep: list[str], fields: str, extra: tuple[str | Column, ...] = ()) -> tuple[DataFrame, T.StructType]:
    """The rows ``row, text, _0, _1 ...`` that :func:`with_results` hands to tasks, and the schema of what it returns."""
    others, present = [c for c in keep if c != text_col], "_present"
    while present in others:
        present += "_"
    source = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others), F.lit(True).alias(present)).alias("row"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *((F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"_{k}") for k, c in enumerate(extra)),
    )
    out = T._parse_datatype_string(fields)
    return source, T.StructType([source.schema["row"], T.StructField("text", T.StringType()), T.StructField("out", out)])


def computing(compute: Callable[..., list[pa.Array]], kept: bool, names: list[str], n_extra: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over batches of :func:`source_rows`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            texts = [t or b"" for t in text.cast(pa.binary()).to_pylist()]
            found = compute(texts, *(batch.column(2 + k).to_pylist() for k in range(n_extra)))
            out = pa.StructArray.from_arrays(found, names=names)
            yield pa.RecordBatch.from_arrays([batch.column(0), text if kept else pa.nulls(len(text), pa.string()), out], ["row", "text", "out"])

    return each


def restored(docs: DataFrame, text_col: str) -> list:
    """The columns of ``docs``, in order, from rows of :func:`with_results` that kept them all."""
    return [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]

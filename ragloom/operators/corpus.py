"""The chunk corpus: one row for each chunk, with the metadata that queries filter on as columns of their own."""

from __future__ import annotations

import time

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import stable

COLUMNS = ["id", "row_seq", "document", "metadata", "embedding"]
#: Metadata keys that are columns too, so that filters on them reach the files.
HOISTED = ["source", "relative_path", "content_kind", "page", "slide", "row", "paragraph_index", "chunk_index", "slide_title", "action_kind", "instruction_role"]
SCHEMA = "id string, row_seq long, document string, metadata string, embedding array<float>"


def metadata_value(metadata: Column, key: str) -> Column:
    """A string or number of the metadata as text; null for anything else, as for malformed JSON."""
    value = F.get_json_object(metadata, f"$.{key}")
    raw = F.regexp_extract(metadata, rf'"{key}"\s*:\s*(.)', 1)
    return F.when(raw.isin('"', "-", *"0123456789"), value)


def metadata_text(metadata: Column, key: str) -> Column:
    """Any value of the metadata as text."""
    return F.get_json_object(metadata, f"$.{key}")


def hoisted(corpus: DataFrame) -> DataFrame:
    """``corpus`` with the columns :data:`HOISTED`: strings and numbers of the metadata as text, null for other values.

    The metadata is parsed once, and the type of a value is its own, whatever else is nested in it. Metadata that does not parse so, as with one key twice,
    is read by :func:`metadata_value`.
    """
    parsed = corpus.withColumn("_parsed", F.try_parse_json("metadata"))

    def value(key: str) -> Column:
        kind = F.schema_of_variant(F.variant_get("_parsed", f"$.{key}", "variant"))
        own = F.when(kind.rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("_parsed", f"$.{key}", "string"))
        return F.when(F.col("_parsed").isNull(), metadata_value(F.col("metadata"), key)).otherwise(own)

    return parsed.withColumns({k: value(k) for k in HOISTED}).drop("_parsed")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def create_if_missing(spark: SparkSession, path: str, attempts: int = 10, wait: float = 5.0) -> DataFrame:
    """The corpus at ``path``; an empty one is made there if there is none. What fails is tried again after ``wait`` seconds, ``attempts`` times in all."""
    for attempt in range(1, attempts + 1):
        try:
            empty(spark).write.mode("ignore").parquet(path)
            return spark.read.schema(SCHEMA).parquet(path)
        except (PySparkException, Py4JError):
            if attempt == attempts:
                raise
            time.sleep(wait)
    raise ValueError("attempts must be positive")


def upsert(corpus: DataFrame, rows: DataFrame, position: str = "position", top: int | None = None) -> DataFrame:
    """``corpus`` with ``rows`` (id, document, metadata, embedding and the order ``position``) inserted or replaced by id.

    Of rows with one id the last counts. Replaced rows keep their ``row_seq``; new ones continue it, or ``top``, in the order of ``rows``. Null
    metadata is ``{}``. The new rows' numbers come from counts of ranges, not from one sorted partition.
    """
    latest = rows.groupBy("id").agg(F.max_by(F.struct("document", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "embedding", F.col(position).alias("_at")), position).alias("r"))
    placed = stable(latest.select("id", "r.*").join(corpus.select("id", "row_seq"), "id", "left"), "placed")
    fresh = numbered(placed.filter("row_seq is null").drop("row_seq"), "_at", "id")
    if top is None:
        top = corpus.agg(F.coalesce(F.max("row_seq"), F.lit(0))).first()[0]
    added = fresh.select("id", (F.lit(top) + F.col("number")).cast("long").alias("row_seq"), "document", "metadata", "embedding")
    replaced = placed.filter("row_seq is not null").select("id", "row_seq", "document", "metadata", "embedding")
    kept = corpus.join(placed.select("id"), "id", "left_anti").select("id", "row_seq", "document", "metadata", "embedding")
    return kept.unionByName(replaced).unionByName(added)


def add_documents(corpus: DataFrame, ids: list[str], documents: list[str], embeddings: list[list[float]], metadatas: list[str] | None = None) -> DataFrame:
    """``corpus`` with a request's documents inserted or replaced. All lists have one length; missing metadata is ``{}``."""
    metadatas = ["{}"] * len(ids) if metadatas is None else metadatas
    if not len(ids) == len(documents) == len(embeddings) == len(metadatas):
        raise ValueError("ids, documents, embeddings and metadatas differ in number")
    rows = corpus.sparkSession.createDataFrame(list(zip(ids, documents, metadatas, embeddings, range(len(ids)))), "id string, document string, metadata string, embedding array<float>, position long")
    return upsert(corpus, rows) if ids else corpus


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number`` from 1 in the order of ``order``, by ranges: each is sorted by itself and starts after those before it. The ranges are written once."""
    parts = stable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranked = parts.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_own")).drop("_part", "_own", "_n", "_before")


def delete(corpus: DataFrame, relative_path: str | None = None, source: str | None = None) -> DataFrame:
    """``corpus`` without the chunks of ``relative_path`` or of ``source``. A missing value deletes nothing."""
    hit = F.lit(False)
    for key, value in (("relative_path", relative_path), ("source", source)):
        if value is not None:
            hit = hit | F.coalesce(metadata_value(F.col("metadata"), key) == value, F.lit(False))
    return corpus.filter(~hit)

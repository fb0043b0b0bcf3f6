"""Incremental ingestion: which file changes count, and how a file's chunks replace its former ones."""

from __future__ import annotations

import time
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions.embedding import embed, hashed
from ragloom.functions.text import chunk_id
from ragloom.operators.chunking import UNSPLIT, number_chunks, split_documents
from ragloom.operators.storage import Conflict, CorpusTable
from ragloom.operators.versions import stable as written
from ragloom.sources.engines import Engines
from ragloom.sources.files import extension
from ragloom.sources.files import parsed as parsed_files
from ragloom.sources.pictures import office_documents

THROTTLE_SECONDS, MOST_RETRIES, RETRY_SECONDS, STABILITY_TRIES = 2.0, 3, 10.0, 5


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.Table]:
    """Rows that follow each other with equal ``columns``, as one table each."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        # the last row that waits, so that a run goes on over batches
        joined = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows]) if held else rows
        differs = np.zeros(joined.num_rows - 1, bool)
        for c in columns:
            values = joined[c].combine_chunks()
            differs |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero(differs) + (0 if held else 1)
        at = 0
        for cut in cuts.tolist():
            yield pa.concat_tables([*held, rows.slice(at, cut - at)]).combine_chunks()
            held, at = [], cut
        held.append(rows.slice(at))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _next(times: np.ndarray, micros: int) -> np.ndarray:
    """The first event ``micros`` or more after each one; itself if there is none."""
    found = np.searchsorted(times, times + micros, "left")
    return np.where(found < len(times), found, np.arange(len(times)))


def throttled(events: DataFrame, seconds: float, path: str = "path", at: str = "ts", key: str = "event_id") -> DataFrame:
    """Events that are accepted: a path's first, and those ``seconds`` or more after its last *accepted* one. Of equal times the smallest key comes first.

    Each event points to the next one that could be accepted after it, and doubling the pointers tells where a chain that enters a range of events leaves it. Ranges are
    of all paths' events in order, so a path with very many of them is many ranges. What leaves one enters the next, and then the
    chains are followed within all ranges at once. Events with a null path or time are left out.
    """
    micros = int(seconds * 1_000_000)
    rows = events.select(F.col(path).alias("p"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(key).alias("k")).filter("p is not null and t is not null")
    time_ = F.timestamp_micros("t").cast("timestamp_ntz")
    if micros <= 0:
        return rows.select(F.col("p").alias(path), F.col("k").alias(key), time_.alias(at))
    ranges = written(rows.repartitionByRange("p", "t", "k").withColumn("part", F.spark_partition_id()), "event-ranges")
    ordered = lambda df: df.repartition("p", "part").sortWithinPartitions("p", "part", "t", "k")

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "p", "part"):
            times = run["t"].to_numpy()
            leaves = _next(times, micros)
            while (further := leaves[leaves]).tobytes() != leaves.tobytes():
                leaves = further
            # a chain enters at the first event that is late enough: no later than ``micros`` after the range begins
            enter = np.arange(min(int(np.searchsorted(times, times[0] + micros, "left")) + 1, len(times)))
            out = times[leaves[enter]]
            last = np.flatnonzero(np.r_[out[1:] != out[:-1], True])
            yield pa.RecordBatch.from_arrays([run["p"].combine_chunks().slice(0, 1), pa.array([run["part"][0].as_py()], pa.int32()), pa.array([times[enter[last]]], pa.list_(pa.int64())), pa.array([out[last]], pa.list_(pa.int64()))], ["p", "part", "until", "leaves"])

    kind = ranges.schema["p"].dataType.simpleString()
    passed = ordered(ranges).mapInArrow(through, f"p {kind}, part int, until array<bigint>, leaves array<bigint>")

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "p"):
            last, enters = None, []
            for until, leaves in zip(run["until"].to_pylist(), run["leaves"].to_pylist()):
                enters.append(last)
                k = 0 if last is None else bisect_left(until, last + micros)
                last = leaves[k] if k < len(leaves) else last
            yield pa.RecordBatch.from_arrays([run["p"].combine_chunks(), run["part"].combine_chunks(), pa.array(enters, pa.int64())], ["p", "part", "last"])

    lasts = passed.repartition("p").sortWithinPartitions("p", "part").mapInArrow(entered, f"p {kind}, part int, last bigint")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "p", "part"):
            times, last = run["t"].to_numpy(), run["last"][0].as_py()
            k = 0 if last is None else int(np.searchsorted(times, last + micros, "left"))
            follow, taken = _next(times, micros).tolist(), []
            while k < len(times):
                taken.append(k)
                if follow[k] == k:
                    break
                k = follow[k]
            if taken:
                yield from run.select(["p", "k", "t"]).take(pa.array(taken)).combine_chunks().to_batches()

    found = ordered(ranges.join(lasts, ["p", "part"])).mapInArrow(chosen, f"p {kind}, k {ranges.schema['k'].dataType.simpleString()}, t bigint")
    return found.select(F.col("p").alias(path), F.col("k").alias(key), time_.alias(at))


def throttle_stream(events: DataFrame, seconds: float = THROTTLE_SECONDS, path: str = "path", at: str = "ts") -> DataFrame:
    """The same over a stream: ``path, ts`` of accepted events. A path's state is the time of its last accepted event."""
    kind = events.schema[path].dataType.simpleString()

    def each(key, frames, state):
        last = state.get[0] if state.exists else None
        times = sorted(t for frame in frames for t in frame[at])
        out = []
        for t in times:
            if last is None or (t - pd.Timestamp(last)).total_seconds() >= seconds:
                out.append(t)
                last = t.to_pydatetime()
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({path: [key[0]] * len(out), at: out})

    return events.select(path, at).groupBy(path).applyInPandasWithState(each, f"{path} {kind}, {at} timestamp", "last timestamp", "append", "NoTimeout")


def unseen(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of ``listing`` (path, modified, length) of which this very version is not in ``ledger``; repeated rows once."""
    return listing.dropDuplicates(["path", "modified", "length"]).join(ledger.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")


def stable(observations: DataFrame, tries: int = STABILITY_TRIES) -> DataFrame:
    """``path, attempt``: files of which two observations in a row (path, attempt, length, modified) are equal, within ``tries``."""
    of = Window.partitionBy("path").orderBy("attempt")
    same = (F.lag("length").over(of) == F.col("length")) & (F.lag("modified").over(of) == F.col("modified"))
    return observations.filter(F.col("attempt") <= tries).withColumn("same", same).filter("same").groupBy("path").agg(F.min("attempt").alias("attempt"))


def retries(attempts: DataFrame, most: int = MOST_RETRIES, key: str = "path", order: str = "attempt") -> DataFrame:
    """``path, attempt, failures, action``: what follows each attempt (``succeeded``): done, retry, or drop.

    Failures count since the last success or drop; the one after ``most`` retries drops the file and the count starts anew.
    """
    ordered = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("a"), F.col("succeeded").alias("ok")))).alias("e"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<a:bigint,n:int,what:string>>").alias("out"))

    def step(acc, e):
        n = F.when(e["ok"], 0).otherwise(acc["n"] + 1)
        what = F.when(e["ok"], "done").when(n > most, "drop").otherwise("retry")
        row = F.struct(e["a"].cast("long").alias("a"), n.alias("n"), what.alias("what"))
        return F.struct(F.when(what == "drop", 0).otherwise(n).alias("n"), F.concat(acc["out"], F.array(row)).alias("out"))

    return ordered.select(key, F.explode(F.aggregate("e", start, step, lambda acc: acc["out"])).alias("x")).select(key, F.col("x.a").alias(order), F.col("x.n").alias("failures"), F.col("x.what").alias("action"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modified, length`` of the files in ``folder`` itself; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")


def prepared(files: DataFrame, parsers: dict | None = None, model: Callable[[list[str]], np.ndarray] = hashed, size: int = 600, overlap: int = 100, engines: Engines | None = None) -> DataFrame:
    """The chunks of files ``path, modified, length, content``, and a row for each file without any.

    ``path, relative_path, source, error`` and ``id, document, metadata, embedding, position`` (null if a file has no content). Tables' rows and slides are chunks as they are,
    other documents are split. A chunk's id is of its file's path, time and length and its number in the file; its metadata
    has the path and that number too. Paths are relative to the folder, which is not searched deeper, so they are names. With ``engines`` the images within Word files and
    presentations are read too.
    """
    name = F.element_at(F.split("path", "/"), -1)
    office = extension(F.col("path")).isin("docx", "pptx")
    docs = parsed_files(files.filter(~office), parsers).unionByName(office_documents(files.filter(office), engines)) if engines else parsed_files(files, parsers)
    whole = extension(F.col("path")).isin(*UNSPLIT) | F.coalesce(F.get_json_object("metadata", "$.type").startswith("pptx_slide"), F.lit(False))
    chunks = number_chunks(split_documents(docs.filter("error is null"), size, overlap, whole=whole))
    about = files.select("path", "modified", "length").distinct()
    placed = chunks.join(about, "path").withColumn("relative_path", name)
    placed = placed.select(
        "path",
        chunk_id(F.col("relative_path"), F.col("modified"), F.col("length"), F.col("chunk_index")).alias("id"),
        F.col("chunk").alias("document"),
        F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), F.lit(", "), F.expr("substring(to_json(named_struct('relative_path', relative_path, 'chunk_index', chunk_index)), 2)")).alias("metadata"),
        F.struct("relative_path", "chunk_index").alias("position"),
    )
    errors = docs.filter("error is not null").groupBy("path").agg(F.first("error").alias("error"))
    rows = about.select("path", name.alias("relative_path"), name.alias("source")).join(errors, "path", "left").join(embed(placed, "document", model=model), "path", "left")
    return rows.select("path", "relative_path", "source", "error", "id", "document", "metadata", "embedding", "position")


def ingest_stream(files: DataFrame, table: CorpusTable, prepare: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "files", most: int = MOST_RETRIES, wait: float = RETRY_SECONDS, keep: int = 2):
    """A running query over a stream of files (see :func:`read_changes`): the chunks of each file of a batch replace its former ones.

    ``prepare`` makes rows as :func:`prepared` does. Files that fail are tried again after ``wait`` seconds, ``most`` times; one that fails still keeps its former
    chunks, and is listed in the folder ``failures`` of the table with its error. A batch is one version of the table, which knows the batches that it
    has, so one that is repeated after a restart changes nothing; if another writer was first, the batch is put upon what that one wrote.
    """
    def each(batch: DataFrame, number: int) -> None:
        rows = written(prepare(batch), "prepared")
        for _ in range(most):
            failed = rows.filter("error is not null").select("path").distinct()
            if failed.isEmpty():
                break
            time.sleep(wait)
            again = written(prepare(batch.join(failed, "path", "left_semi")), "prepared")
            rows = written(rows.join(failed, "path", "left_anti").unionByName(again), "prepared")
        good = rows.filter("error is null")
        failures = rows.filter("error is not null").select("path", "error").distinct()
        if not failures.isEmpty():
            failures.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{table.path}/failures")
        if good.isEmpty():
            return
        while True:
            try:
                table.replace_files(good.filter("id is not null"), good.select("relative_path", "source"), batch=(name, number))
                break
            except Conflict:
                time.sleep(0.1)
        table.expire(keep)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()

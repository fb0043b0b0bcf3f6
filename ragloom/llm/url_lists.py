"""URL filters by a temporal join with dated lists, in DataFrame operations only.

Entries of block and allow lists are dated: added, removed, perhaps added again. Each becomes
intervals in which it holds. A capture is evaluated against what held when it was fetched: its host's suffixes
and its path's prefixes are joined with the entries on the key, as of its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and last dot; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r"(:\d*)?$|\.(:\d*)?$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """All keys that an entry for this URL may have: each suffix of the host, and the host with each prefix of the path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def entry_key(key: Column) -> Column:
    """An entry's key with its host in lower case; the path keeps its case, as in :func:`keys_of`."""
    return F.concat(F.lower(F.regexp_extract(key, "^[^/]*", 0)), F.regexp_extract(key, "(?s)/.*$", 0))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, key, valid_from, valid_to`` of dated entries ``list, key, action, day``.

    ``action`` is add or remove. An entry holds from the day it is added until the day it is removed (excluded, null if it never is).
    On one day a removal comes first, so an entry that is removed and added holds on. Repeated rows change nothing.
    The host of a key is compared in lower case, its path as it is. Entries with a null key, day or action are ignored.
    """
    clean = entries.select("list", entry_key(F.col("key")).alias("key"), "action", "day").filter("key is not null and day is not null and action in ('add', 'remove')")
    daily = clean.groupBy("key", "list", "day").agg(F.max(F.col("action") == "add").alias("holds"))
    of = Window.partitionBy("key", "list").orderBy("day")
    changes = daily.withColumn("before", F.lag("holds").over(of)).filter(F.col("before").isNull() | (F.col("before") != F.col("holds")))
    return changes.withColumn("valid_to", F.lead("day").over(of)).filter("holds").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``id, host, day, blocked, allowed, n_entries, entries`` for each capture (rows of one id, URL and day are one).

    ``n_entries`` counts the entries that hold for the capture on its day and ``entries`` names them, sorted, as list:key. A
    capture is blocked if a block entry holds and no allow entry does. A null or odd URL has no host and matches nothing; with a null day
    nothing holds either. The intervals are a written table: Spark broadcasts them if they are small enough by its own
    measure, and else joins both sides sorted by key, where it splits hot keys.
    """
    held = written(intervals(entries), "url-intervals")
    slim = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(day_col).alias("day"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("_path"))
    keyed = slim.select("_id", "_url", "day", "host", F.explode_outer(keys_of(F.col("host"), F.col("_path"))).alias("_key"))
    joined = keyed.join(held, (F.col("_key") == F.col("key")) & (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day"))), "left")
    names = F.array_sort(F.collect_set(F.when(F.col("key").isNotNull(), F.concat_ws(":", "list", "key"))))
    found = joined.groupBy("_id", "_url", "day", "host").agg(
        F.coalesce(F.max(F.col("list") == "block"), F.lit(False)).alias("_block"), F.coalesce(F.max(F.col("list") == "allow"), F.lit(False)).alias("allowed"), names.alias("_names")
    )
    return found.select(F.col("_id").alias(id_col), "host", "day", (F.col("_block") & ~F.col("allowed")).alias("blocked"), "allowed", F.size("_names").cast("long").alias("n_entries"), F.array_join("_names", ",").alias("entries"))


def demo_entries(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Dated entries for the hosts, parent domains and first path parts of ``pages``, chosen by a hash of the key.

    The tables have no lists of their own; these stand for them. A key's MD5 decides whether it is listed, in which list,
    and when it is added, removed and added again in 2024.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    keys = pages.select(host.alias("host"), path.alias("path")).filter("host <> ''")
    first = F.regexp_extract("path", "^/([^/]+)", 1)
    each = F.array(F.col("host"), F.regexp_extract("host", r"[^.]+\.[^.]+$", 0), F.when(first != "", F.concat("host", F.lit("/"), first)))
    listed = keys.select(F.explode(each).alias("key")).filter("key <> ''").distinct().withColumn("h", F.md5("key"))
    number = lambda at, m: (F.conv(F.substring("h", at, 4), 16, 10).cast("int") % m)
    start = F.lit("2024-01-01").cast("date")
    dated = listed.filter(number(1, 3) == 0).select(
        "key",
        F.when(number(5, 4) == 0, "allow").otherwise("block").alias("list"),
        F.date_add(start, number(9, 200)).alias("added"),
        number(13, 3).alias("fate"),
        (number(17, 100) + 1).alias("after"),
        (number(21, 60) + 1).alias("again"),
    )
    add = dated.select("list", "key", F.lit("add").alias("action"), F.col("added").alias("day"))
    remove = dated.filter("fate >= 1").select("list", "key", F.lit("remove").alias("action"), F.expr("date_add(added, after)").alias("day"))
    readd = dated.filter("fate = 2").select("list", "key", F.lit("add").alias("action"), F.expr("date_add(added, after + again)").alias("day"))
    return add.unionAll(remove).unionAll(readd)

"""Throttling against a plain walk, with a path that holds most events in many ranges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ragloom.streaming import files

START = datetime.datetime(2024, 1, 1)


def plain(events, seconds):
    taken, last = set(), {}
    for path, at, key in sorted((p, t, k) for k, p, t in events if p is not None and t is not None):
        if path not in last or (at - last[path]).total_seconds() >= seconds:
            taken.add(key)
            last[path] = at
    return taken


@pytest.mark.parametrize("seconds", [0, 0.5, 2, 60, 10**6])
def test_one_path_with_nearly_all_events(spark, seconds, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few events would be one range
    r = random.Random(8)
    at = lambda: START + datetime.timedelta(milliseconds=r.choice([r.randrange(600_000), r.randrange(60) * 10_000, 300_000 + r.randrange(900)]))
    events = [(k, "hot" if k % 20 else f"p{k % 7}", at()) for k in range(6000)] + [(9001, None, START), (9002, "hot", None), (9003, "single", START)]
    df = spark.createDataFrame(events, "event_id long, path string, ts timestamp").repartition(3)
    ranges = []
    written = files.written
    monkeypatch.setattr(files, "written", lambda rows, name: ranges.append(written(rows, name)) or ranges[-1])
    try:
        rows = files.throttled(df, seconds).collect()
        assert not seconds or ranges[0].filter("p = 'hot'").select("part").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.event_id for r in rows} == plain(events, seconds) and len(rows) == len({r.event_id for r in rows})
    by_key = {k: t for k, _, t in events}
    assert all(r.ts == by_key[r.event_id] for r in rows)


def test_no_events(spark):
    assert files.throttled(spark.createDataFrame([], "event_id long, path string, ts timestamp"), 2).count() == 0


def test_a_burst_of_equal_times(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit(7).alias("path"), (F.lit(START) + F.expr("make_dt_interval(0, 0, 0, id div 5000)")).alias("ts"))
    assert sorted(r.event_id for r in files.throttled(df, 1).collect()) == [0, 5000, 10000, 15000]

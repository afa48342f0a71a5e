"""Streams against the batch answer over closed windows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from checks.queries import as_progress, as_wal_files
from fleetlens.streaming.follow import follow_progress
from fleetlens.streaming.progress import progress_watch
from fleetlens.streaming.run import snapshot_stream, write_stream
from fleetlens.streaming.wal import wal_hourly_watch
from tests.conftest import SF


def run(spark, df, folder):
    write_stream(df, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def test_progress_equals_batch_over_closed_windows(spark, tmp_path):
    stream = snapshot_stream(spark, SF, events(spark).schema, glob="events.parquet")
    args = {"keys": (), "window": "1 day", "delay": "1 hour"}
    found = run(spark, progress_watch(as_progress(stream), **args), tmp_path)
    closed = events(spark).agg(F.max(F.col("ts").cast("timestamp")) - F.expr("interval 1 hour")).first()[0]
    batch = progress_watch(as_progress(events(spark)), **args).filter(F.col("window_end") <= F.lit(closed))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
    assert found.count() > 300


def snapshots(spark, folder, number, rows):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("c", at + dt.timedelta(minutes=m), p, "scanning", d, 100) for m, p, d in rows],
        "cluster_id string, snapshot_ts timestamp, pid bigint, phase string, blocks_done bigint, blocks_total bigint")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return df.schema


def test_copies_count_once_and_late_rows_are_dropped(spark, tmp_path):
    first = [(0, 1, 10), (0, 1, 10), (2, 1, 20), (4, 1, 40), (1, 2, 5), (40, 1, 90)]
    schema = snapshots(spark, tmp_path, 0, first)
    watch = lambda: progress_watch(
        snapshot_stream(spark, f"{tmp_path}/in", schema, files_per_batch=1), view="pg_stat_progress_create_index", delay="10 minutes")
    run(spark, watch(), tmp_path)
    # The watermark is at minute 30: a row of minute 3 is too late, one of 35 is not.
    snapshots(spark, tmp_path, 1, [(3, 1, 99), (36, 1, 80), (90, 1, 100)])
    rows = run(spark, watch(), tmp_path).orderBy("window_start", "pid").collect()
    assert [(r.window_start.minute, r.pid, r.samples, r.done) for r in rows] == [(0, 1, 3, 40), (0, 2, 1, 5), (35, 1, 1, 80), (40, 1, 1, 90)]
    assert (rows[0].done_per_second, rows[0].seconds_left) == (30 / 240, 480.0)
    assert rows[1].seconds_left is None


def test_wal_hours_equal_batch(spark, tmp_path):
    stream = snapshot_stream(spark, SF, events(spark).schema, glob="events.parquet")
    found = run(spark, wal_hourly_watch(as_wal_files(stream), keys=()), tmp_path)
    batch = as_wal_files(events(spark)).filter("file_ls <> 'archive_status'").withColumn("h", F.date_trunc("hour", F.col("modification").cast("timestamp")))
    last = batch.agg(F.max(F.col("modification").cast("timestamp"))).first()[0]
    expected = batch.filter(F.col("h") + F.expr("interval 2 hours") <= F.lit(last)).groupBy(
        F.date_format("h", "yyyyMMdd"), F.hour("h")).count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def poll_rows(minutes):
    at = dt.datetime(2024, 1, 1)
    return [("c", at + dt.timedelta(minutes=m), p, phase, d, 100) for m, p, phase, d in minutes]


POLLS = "cluster_id string, snapshot_ts timestamp, pid bigint, phase string, heap_blks_scanned bigint, heap_blks_total bigint"


def test_following_survives_restarts_and_any_cut_into_files(spark, tmp_path):
    """Polls out of order, repeated, over files and restarts give what windows give at once."""
    r = random.Random(5)
    polls = []
    for pid in range(6):
        m, done = 0, 0
        while m < 400:
            m += r.choice([1, 2, 3, 3, 45])
            done += r.choice([0, 0, 0, 4])
            polls.append((m, pid, r.choice(["scan", "scan", "scan", "vacuum"]) if pid % 2 else "scan", done))
    polls += r.sample(polls, 20)  # delivered twice
    polls += [(5, 1, "scan", None), (5, 1, None, 7), (90, 9, None, None)]
    polls.sort(key=lambda p: p[0] + r.random() * 8)  # within the delay
    args = {"last": 3, "stall_after": "6 minutes", "expire_after": "30 minutes", "delay": "10 minutes"}
    cuts = [0, 60, 61, 130, 300, len(polls)]
    outs = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df = spark.createDataFrame(poll_rows(polls[a:b]), POLLS)
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        stream = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        outs.append(run(spark, follow_progress(stream, **args), tmp_path))
    until = max(p[0] for p in polls) - 10
    end = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=until)).cast("timestamp")
    batch = follow_progress(spark.createDataFrame(poll_rows(polls), POLLS), **args, until=end)
    found = sorted(map(str, outs[-1].collect()))
    assert found == sorted(map(str, batch.collect()))
    kinds = {k: sum(f"kind='{k}'" in f for f in found) for k in ("progress", "stalled", "gone")}
    assert min(kinds.values()) > 3


def test_following_needs_no_setting_of_the_session(spark, tmp_path):
    """Sessions of Spark's own settings keep state in a store without column families."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    polls = [(0, 1, "scan", 10), (2, 1, "scan", None), (4, None, None, 2**60 + 1), (5, None, "scan", None), (300, 2, "scan", 1)]
    spark.createDataFrame(poll_rows(polls), POLLS).coalesce(1).write.parquet(f"{tmp_path}/in/part=0")
    stream = spark.readStream.schema(POLLS).parquet(f"{tmp_path}/in/*")
    before = spark.conf.get(provider)
    spark.conf.unset(provider)
    try:
        found = run(spark, follow_progress(stream), tmp_path).collect()
    finally:
        spark.conf.set(provider, before)
    end = F.lit(dt.datetime(2024, 1, 1, 4, 50)).cast("timestamp")
    batch = follow_progress(spark.createDataFrame(poll_rows(polls), POLLS), until=end)
    assert sorted(map(str, found)) == sorted(map(str, batch.collect())) and len(found) == 6


def test_following_a_batch_by_hand(spark):
    polls = [(0, 1, "scan", 10), (1, 1, "scan", 16), (2, 1, "scan", 16), (9, 1, "scan", 16), (12, 1, "scan", 16), (13, 1, "scan", 40), (50, 1, "scan", 41)]
    rows = follow_progress(spark.createDataFrame(poll_rows(polls), POLLS), last=2, stall_after="8 minutes", expire_after="20 minutes")
    told = [(r.seen_at.hour * 60 + r.seen_at.minute, r.kind, r.done, r.polls, r.rate, r.stalled_for) for r in rows.orderBy("seen_at").collect()]
    assert told == [
        (0, "progress", 10, 1, None, 0.0), (1, "progress", 16, 2, 0.1, 0.0), (2, "progress", 16, 3, 0.0, 60.0),
        (9, "stalled", 16, 4, 0.0, 480.0), (12, "progress", 16, 5, 0.0, 660.0), (13, "progress", 40, 6, 0.4, 0.0),
        (33, "gone", 40, 6, 0.4, 0.0), (50, "progress", 41, 1, None, 0.0), (70, "gone", 41, 1, None, 0.0),
    ]

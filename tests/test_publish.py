"""Bundles published at once, batches written twice, and listings."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.queries import as_wal_files
from fleetlens.operators.server import NOT_WAL
from fleetlens.sources.listing import files_of
from fleetlens.sources.publish import PublishedByOther, publish, published, versions
from fleetlens.streaming.late import add_batch, hours, late_files
from tests.conftest import SF


def counts(spark, root, version=None):
    return {name: df.count() for name, df in published(spark, root, version).items()}


def test_a_reader_sees_one_version_whole(spark, tmp_path):
    root = f"{tmp_path}/out"
    assert versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        published(spark, root)
    assert publish({"a": spark.range(3), "b": spark.range(5)}, root) == 1
    reading = published(spark, root)
    assert publish({"a": spark.range(30), "b": spark.range(50).filter("false"), "c": spark.range(1)}, root) == 2
    assert {n: df.count() for n, df in reading.items()} == {"a": 3, "b": 5}
    assert counts(spark, root) == {"a": 30, "b": 0, "c": 1} and counts(spark, root, 1) == {"a": 3, "b": 5}
    assert published(spark, root)["b"].columns == ["id"]


def test_a_failed_run_leaves_nothing_visible(spark, tmp_path):
    root = f"{tmp_path}/out"
    publish({"a": spark.range(3)}, root)
    broken = spark.range(2).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken"):
        publish({"a": spark.range(9), "b": broken}, root)
    assert versions(spark, root) == [1] and counts(spark, root) == {"a": 3}
    with pytest.raises(ValueError, match="no reports"):
        publish({}, root)


def test_of_two_writers_of_one_version_one_wins(spark, tmp_path):
    root = f"{tmp_path}/out"
    assert publish({"a": spark.range(3)}, root, version=7) == 7
    with pytest.raises(PublishedByOther):
        publish({"a": spark.range(4)}, root, version=7)
    assert counts(spark, root) == {"a": 3} and versions(spark, root) == [7]
    assert not [f for f in (tmp_path / "out" / "manifests").iterdir() if f.name.endswith("draft")]


def test_a_batch_written_twice_counts_once_and_late_files_are_kept(spark, tmp_path):
    at = lambda day, hour, minute=0: dt.datetime(2024, 1, day, hour, minute)
    schema = "cluster_id string, file_ls string, modification timestamp, day_id string"
    batches = [
        [("c", "f1", at(1, 5)), ("c", "f2", at(1, 9, 30)), ("d", "f3", at(1, 8)), ("c", NOT_WAL[0], at(1, 5)), ("c", "f0", None)],
        [("c", "f4", at(1, 7, 59)), ("c", "f5", at(1, 8, 10)), ("c", "f6", at(2, 0))],
        [("c", "f7", at(1, 22)), ("c", "f8", at(1, 23, 30)), ("c", "f9", at(2, 0, 30))],
    ]
    for n in (0, 1, 1, 0, 2, 1, 2):  # as after failures
        df = spark.createDataFrame([(*r, "x") for r in batches[n]], schema)
        add_batch(df, n, f"{tmp_path}/t", ["cluster_id"])
    found = sorted(map(tuple, hours(spark, f"{tmp_path}/t", ["cluster_id"]).collect()))
    # The first batch's newest file is of 9:30, so hours that end by 8:30 are closed for the second.
    assert found == [("c", "20240101", 5, 1), ("c", "20240101", 8, 1), ("c", "20240101", 9, 1), ("c", "20240101", 23, 1),
                     ("c", "20240102", 0, 2), ("d", "20240101", 8, 1)]
    late = sorted((r["file_ls"], r["day_id"], r["hour"], r["batch"]) for r in late_files(spark, f"{tmp_path}/t").collect())
    assert late == [("f4", "20240101", 7, 1), ("f7", "20240101", 22, 2)]


def test_counts_and_late_files_are_all_files(spark, tmp_path):
    files = as_wal_files(spark.read.parquet(f"{SF}/events.parquet").repartition(2, "event_id"))
    for n in range(3):
        add_batch(files.filter(F.pmod(F.xxhash64("file_ls"), F.lit(3)) == n), n, f"{tmp_path}/t", [])
    counted = hours(spark, f"{tmp_path}/t").agg(F.sum("wal_num")).first()[0]
    late = late_files(spark, f"{tmp_path}/t").count()
    assert late > 100 and counted + late == files.filter(~F.col("file_ls").isin(*NOT_WAL)).count()


def test_listing_is_that_of_the_file_system(spark):
    ours = sorted((r["file"], r["size"], r["modification"]) for r in files_of(spark, SF, "*.parquet").collect())
    theirs = duckdb.sql(f"select parse_filename(filename), size, epoch_ms(last_modified) from read_blob('{SF}/*.parquet')").fetchall()
    assert [(f, s) for f, s, _ in ours] == sorted((f, s) for f, s, _ in theirs) and len(ours) == 14
    times = {f: t for f, _, t in theirs}
    assert all(abs(m.replace(tzinfo=dt.timezone.utc).timestamp() - times[f] / 1000) < 86400 for f, _, m in ours)

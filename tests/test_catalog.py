"""Sources, sinks and the catalog itself."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.fixtures import load
from fleetlens import Catalog
from fleetlens.operators import server, sessions
from fleetlens.sources.lock_modes import lock_conflicts
from fleetlens.sources.sink import show, write
from fleetlens.sources.wal import wal_files
from tests.conftest import SF
from tests.helpers import small_catalog, values


def land(spark, root):
    activity = (
        load(spark, SF, "pg_stat_activity")
        .withColumns({
            "cluster_id": F.concat(F.lit("c"), (F.col("pid") % 3).cast("string")),
            "snapshot_ts": F.date_trunc("hour", F.col("query_start").cast("timestamp")),
        })
        .drop("application_name")
    )
    write(activity, f"{root}/pg_stat_activity")
    return activity


def test_landed_snapshots_are_pruned_and_old_exports_read(spark, tmp_path):
    activity = land(spark, str(tmp_path))
    c = Catalog.from_path(spark, str(tmp_path), since="2024-01-03", until="2024-01-04")
    assert c.has("pg_stat_activity") and not c.has("pg_locks")
    df = sessions.connection_summary(c)
    day = F.to_date("snapshot_ts").between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-04").cast("date"))
    assert df.filter("is_total").agg(F.sum("open")).first()[0] == activity.filter(day).count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert "query:string" not in plan, "columns the report does not use are not read"
    assert c.table("pg_stat_activity").select("application_name").distinct().collect() == [(None,)]
    with pytest.raises(KeyError):
        c.table("pg_locks")


def test_filters_reach_the_scan(spark, tmp_path):
    land(spark, str(tmp_path))
    df = sessions.running_queries(Catalog.from_path(spark, str(tmp_path)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(state,idle))" in plan.split("PushedFilters")[1]


def test_now_is_the_snapshot_time(spark, tmp_path):
    land(spark, str(tmp_path))
    row = sessions.running_queries(Catalog.from_path(spark, str(tmp_path))).agg(F.min("age"), F.max("age")).first()
    assert -3600 < row[0] <= row[1] <= 0


def test_unknown_views_are_refused(spark):
    with pytest.raises(ValueError, match="pg_nothing"):
        Catalog({"pg_nothing": spark.range(1)})


def test_setting_is_a_scalar_for_one_server_and_a_join_for_many(spark):
    one = small_catalog(spark)
    assert values(one.with_setting(spark.range(1), "block_size", "bigint"), "block_size") == [8192]
    many = small_catalog(spark, ("cluster_id",), settings=[
        {"name": "block_size", "setting": s, "cluster_id": k} for k, s in [(1, "8192"), (2, "32768")]])
    df = spark.createDataFrame([(1,), (2,), (3,)], "cluster_id bigint")
    assert values(many.with_setting(df, "block_size", "bigint").orderBy("cluster_id"), "block_size") == [8192, 32768, None]


def test_reports_can_skip_the_sort(spark):
    c = small_catalog(spark)
    assert "Sort" in sessions.wait_events(c)._jdf.queryExecution().optimizedPlan().toString()
    c.ordered = False
    assert "Sort" not in sessions.wait_events(c)._jdf.queryExecution().optimizedPlan().toString()


def test_directory_listing(spark, tmp_path):
    (tmp_path / "archive_status").mkdir()
    for name, n in [("000000010000000000000001", 3), ("000000010000000000000002", 5)]:
        (tmp_path / name).write_bytes(b"x" * n)
    df = wal_files(spark, str(tmp_path))
    assert sorted(values(df, "file_ls", "size")) == [("000000010000000000000001", 3), ("000000010000000000000002", 5)]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()
    c = Catalog({"wal_files": df}, keys=[], now=F.current_timestamp())
    assert server.wal_hourly(c).agg(F.sum("wal_num_all")).first()[0] == 2


def test_lock_conflicts_are_symmetric(spark):
    pairs = set(values(lock_conflicts(spark), "requested", "held"))
    assert len(pairs) == 38
    assert {(b, a) for a, b in pairs} == pairs


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_sink(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 2))], "x int, snapshot_ts timestamp")
    write(df, f"{tmp_path}/out", fmt)
    write(df, f"{tmp_path}/out", fmt, mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "out").glob("snapshot_date=*")) == ["snapshot_date=2024-01-01", "snapshot_date=2024-01-02"]
    assert spark.read.format(fmt).load(f"{tmp_path}/out").count() == 2
    write(spark.range(3), f"{tmp_path}/plain", fmt)
    assert spark.read.format(fmt).load(f"{tmp_path}/plain").count() == 3


def test_show(spark, capsys):
    show(spark.range(1), one_field_per_line=True)
    assert "RECORD 0" in capsys.readouterr().out


def test_a_report_written_twice_is_there_once(spark, tmp_path):
    df = spark.sql("select timestamp '2024-01-01 10:00:00' as snapshot_ts, id from range(3)")
    for _ in range(2):
        write(df, f"{tmp_path}/twice")
    write(df.selectExpr("snapshot_ts + interval 1 day as snapshot_ts", "id"), f"{tmp_path}/twice")
    assert spark.read.parquet(f"{tmp_path}/twice").count() == 6

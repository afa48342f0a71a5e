"""Where walks keep their levels, and when they stop."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fleetlens.plans.levels import FREE_SHUFFLES, cut_lineage, drop_rows, ensure_checkpoint_dir, stow_rows, walk_levels


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):  # noqa: N802 - Spark's name
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def session(master, folder=None, **conf):
    return SimpleNamespace(
        sparkContext=Context(master, folder), conf=SimpleNamespace(get=lambda key, default: conf.get("setting", default))
    )


def test_the_cluster_names_the_folder():
    assert ensure_checkpoint_dir(session("yarn", "hdfs:///set")) == "hdfs:///set"
    assert ensure_checkpoint_dir(session("yarn", setting="hdfs:///shared")) == "hdfs:///shared"


def test_a_local_folder_is_for_local_mode_only():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session("yarn"))
    assert "fleetlens-checkpoint" in ensure_checkpoint_dir(session("local[2]"))


def test_lineage_is_cut(spark):
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "LogicalRDD" in plan


def test_walk_ends_with_an_empty_level_or_at_its_limit(spark):
    def step(level, depth):
        return level.filter("id > 0").withColumn("id", F.col("id") - 1)

    assert [x.count() for x in walk_levels(spark.range(3), step)] == [3, 2, 1, 0]
    assert [x.count() for x in walk_levels(spark.range(3), step, max_levels=2)] == [3, 2]


def test_stowed_rows_leave_no_shuffles(spark):
    def shuffles() -> int:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    wide = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    before = shuffles()
    stowed = stow_rows(wide)
    assert shuffles() <= before
    assert spark.conf.get(FREE_SHUFFLES, None) in (None, "false")
    assert sorted(map(tuple, stowed.collect())) == sorted(map(tuple, wide.collect()))
    folder = Path(stowed.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists()
    drop_rows(stowed)
    assert not folder.exists()

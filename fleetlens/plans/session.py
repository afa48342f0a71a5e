"""Session settings the reports are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution does the run-time half of the planning: it merges small
#: shuffle partitions, splits skewed ones and turns a join into a broadcast when
#: the measured size of a side is below the threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side even where that costs another shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    # Parquet is smaller than its rows: keep the planner from broadcasting a
    # side because its files look small.
    "spark.sql.sources.fileCompressionFactor": "3.0",
    # Checkpoints of walks go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # State of streams on local disk rather than on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}


def build_session(app: str = "fleetlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``extra`` uses ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

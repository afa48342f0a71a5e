"""Following running commands from snapshot to snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import ratio
from fleetlens.functions.times import exact_seconds_between

#: Progress counters of each command: view -> (done, total).
COUNTERS = {
    "pg_stat_progress_vacuum": ("heap_blks_scanned", "heap_blks_total"),
    "pg_stat_progress_create_index": ("blocks_done", "blocks_total"),
}


def progress_watch(
    stream: DataFrame,
    view: str = "pg_stat_progress_vacuum",
    keys: Sequence[str] = ("cluster_id",),
    time: str = "snapshot_ts",
    window: str = "5 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Per session and window: latest state, rate and time left.

    Works on a stream of progress snapshots and, for the same rows, on a batch.
    A snapshot delivered twice counts once. Rows later than ``delay`` are
    dropped; in append mode a window appears when the watermark passes its end.
    The state holds one small row per open window and session.
    """
    done, total = COUNTERS[view]
    at = F.col(time)
    watched = (
        stream.withColumn(time, at.cast("timestamp"))
        .withWatermark(time, delay)
        .select(time, *keys, "pid", "phase", F.col(done).alias("done"), F.col(total).alias("total"))
    )
    if stream.isStreaming:
        watched = watched.dropDuplicatesWithinWatermark([*keys, "pid", time])
    else:
        watched = watched.dropDuplicates([*keys, "pid", time])
    state = F.struct("done", "total", "phase")
    per_window = watched.groupBy(F.window(time, window).alias("span"), *keys, "pid").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min(at).alias("first_seen"),
        F.max(at).alias("last_seen"),
        F.min_by("done", at).alias("first_done"),
        F.max_by(state, at).alias("last"),
    )
    rate = ratio(
        F.col("last.done") - F.col("first_done"),
        exact_seconds_between(F.col("first_seen"), F.col("last_seen")),
    )
    left = F.col("last.total") - F.col("last.done")
    return per_window.withColumn("rate", rate).select(
        F.col("span.start").alias("window_start"),
        F.col("span.end").alias("window_end"),
        *keys,
        "pid",
        "samples",
        F.col("last.phase").alias("phase"),
        F.col("last.done").alias("done"),
        F.col("last.total").alias("total"),
        F.col("rate").alias("done_per_second"),
        F.when(F.col("rate") > 0, F.round(ratio(left, F.col("rate")), 1)).alias("seconds_left"),
    )

"""Server-wide counters and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import int_div, ratio
from fleetlens.functions.order import down, up
from fleetlens.functions.text import human_bytes
from fleetlens.functions.times import exact_seconds_between
from fleetlens.sources.catalog import Catalog

# Counters a server version adds to the report.
COUNTERS_FROM_12 = ["checksum_failures"]
COUNTERS_FROM_15 = [
    "session_time", "active_time", "idle_in_transaction_time", "sessions", "sessions_abandoned",
    "sessions_fatal", "sessions_killed",
]


def database_status(c: Catalog, version: int = 15) -> DataFrame:
    """Size, cache hits, commits, conflicts and timings of every database in use."""

    def share(part: str, other: str) -> Column:
        whole = int_div(F.col(part) * 100, F.col(part) + F.col(other))
        return F.concat(whole.cast("string"), F.lit(" %" if version >= 15 else "%"))

    counters = ["blk_read_time", "blk_write_time"]
    if version in (12, 13) or version >= 15:
        counters = COUNTERS_FROM_12 + counters
    if version >= 15:
        counters = counters + COUNTERS_FROM_15
    df = (
        c.table("pg_stat_database")
        .filter((F.col("blks_hit") + F.col("blks_read") > 0) & ~F.col("datname").like("%template%"))
        .join(c.pick("pg_database", datid="oid", size_bytes="database_size"), c.on("datid"), "left")
        .select(
            *c.keys,
            F.col("datname").alias("database_name"),
            human_bytes(F.col("size_bytes")).alias("database_size"),
            share("blks_hit", "blks_read").alias("cache_hit_ratio"),
            share("xact_commit", "xact_rollback").alias("commit_ratio"),
            "conflicts",
            "temp_files",
            human_bytes(F.col("temp_bytes")).alias("temp_bytes"),
            "deadlocks",
            *counters,
        )
    )
    return c.sort(df, up("database_name"))


def checkpoint_stats(c: Catalog) -> DataFrame:
    """Checkpoints, what each writer wrote, average size and distance."""
    df = c.with_setting(c.table("pg_stat_bgwriter"), "block_size", "bigint")
    df = c.with_server_info(df, "postmaster_start").withColumn(
        "total_checkpoints", F.col("checkpoints_timed") + F.col("checkpoints_req")
    )
    n = F.col("total_checkpoints")

    def written(column: str) -> Column:
        return F.col("block_size") * F.col(column)

    up_seconds = exact_seconds_between(F.col("postmaster_start"), c.now)
    df = df.select(
        *c.on("total_checkpoints"),
        human_bytes(written("buffers_clean")).alias("bgworker_total_writen"),
        human_bytes(written("buffers_checkpoint")).alias("chkpointer_total_writen"),
        human_bytes(written("buffers_backend")).alias("backend_total_writen"),
        human_bytes(int_div(written("buffers_checkpoint"), n)).alias("checkpoint_write_avg"),
        (ratio(up_seconds, n) / 60).alias("minutes_between_checkpoints"),
        "buffers_backend_fsync",
    )
    return c.sort(df) if c.keys else df


def wal_archive_state(c: Catalog) -> DataFrame:
    """Archiver counters, whether archiving works, files per second since reset.

    Archiving works when it is on (in any mode) and the last failure, if any,
    is not newer than the last success; file names have a fixed width, so they
    compare as text.
    """
    on = F.lower("archive_mode").isin("on", "always", "true", "yes", "1")
    df = c.with_setting(c.table("pg_stat_archiver"), "archive_mode", "string").withColumns(
        {
            "is_archiving": on
            & (
                F.col("last_failed_wal").isNull()
                | (F.col("last_failed_wal") <= F.col("last_archived_wal"))
            ),
            "current_archived_wals_per_second": ratio(
                F.col("archived_count"), exact_seconds_between(F.col("stats_reset"), c.now)
            ),
        }
    ).drop("archive_mode")
    return c.sort(df) if c.keys else df


#: Entries of the log directory that are not log files.
NOT_WAL = ["archive_status"]


def wal_hourly(c: Catalog) -> DataFrame:
    """Log files per day, in all and for each hour of the day, newest day first.

    All 25 counts come from one aggregate, partial before the shuffle.
    """
    hour = F.hour("modification")
    df = (
        c.table("wal_files")
        .filter(~F.col("file_ls").isin(*NOT_WAL))
        .groupBy(*[F.col(k) for k in c.keys], F.date_format("modification", "yyyyMMdd").alias("day_id"))
        .agg(
            F.count("modification").alias("wal_num_all"),
            *[F.count_if(hour == h).alias(f"wal_num_{h:02d}_{h + 1:02d}") for h in range(24)],
        )
    )
    return c.sort(df, down("day_id"))


def wal_stats(c: Catalog) -> DataFrame:
    """The log statistics view as it is."""
    return c.table("pg_stat_wal")

"""Standby servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import int_div, lsn_to_long
from fleetlens.functions.order import up
from fleetlens.functions.times import exact_seconds_between
from fleetlens.sources.catalog import Catalog

KIB = 1024


def _standbys(c: Catalog) -> DataFrame:
    return c.table("pg_stat_replication").withColumnsRenamed(
        {"client_addr": "client", "usename": "user", "application_name": "name", "sync_state": "mode"}
    )


def replication_lag_time(c: Catalog) -> DataFrame:
    """State of each standby with its lags in seconds."""
    df = _standbys(c).select(
        *c.on("client", "user", "name", "state", "mode", "write_lag", "flush_lag", "replay_lag")
    )
    return c.sort(df, up("client"))


def replication_lag_bytes(c: Catalog) -> DataFrame:
    """State of each standby with its lags in KiB of log.

    The parts are rounded, the total is cut off.
    """

    def behind(ahead: str, at: str) -> Column:
        return lsn_to_long(F.col(ahead)) - lsn_to_long(F.col(at))

    def rounded(ahead: str, at: str) -> Column:
        return F.round(behind(ahead, at) / KIB, 0).cast("bigint")

    df = _standbys(c).select(
        *c.on("client", "user", "name", "state", "mode"),
        rounded("current_lsn", "sent_lsn").alias("pending"),
        rounded("sent_lsn", "write_lsn").alias("write"),
        rounded("write_lsn", "flush_lsn").alias("flush"),
        rounded("flush_lsn", "replay_lsn").alias("replay"),
        int_div(behind("current_lsn", "replay_lsn"), F.lit(KIB)).alias("total_lag"),
    )
    return c.sort(df, up("client"))


def replication_lag(c: Catalog, version: int = 15) -> DataFrame:
    """Lags in time from version 10 on, in log bytes before."""
    return replication_lag_time(c) if version >= 10 else replication_lag_bytes(c)


def standby_state(c: Catalog) -> DataFrame:
    """What a standby has received and replayed, and how far it is behind."""
    lag = exact_seconds_between(F.col("last_replay_time"), c.now)
    df = c.table("server_info").select(
        *c.keys,
        F.col("in_recovery").alias("is_slave"),
        F.col("receive_lsn").alias("receive"),
        F.col("replay_lsn").alias("replay"),
        (F.col("receive_lsn") == F.col("replay_lsn")).alias("synced"),
        F.round(lag, 0).cast("bigint").alias("lag"),
    )
    return c.sort(df) if c.keys else df

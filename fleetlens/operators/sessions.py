"""What sessions are doing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.order import down, up
from fleetlens.functions.times import seconds_between
from fleetlens.sources.catalog import Catalog

STATES = {"active": "active", "idle": "idle", "idle_in_trans": "idle in transaction"}


def connection_summary(c: Catalog) -> DataFrame:
    """Connections per database and in total.

    ``is_total`` tells the total from the row of sessions without a database;
    both have a NULL name. The raw rows are aggregated once; the total is made
    from the per-database counts.
    """
    counts = ["open", *STATES]
    per_database = (
        c.table("pg_stat_activity")
        .groupBy(*c.on("datname"))
        .agg(
            F.count(F.lit(1)).alias("open"),
            *[F.count_if(F.col("state") == state).alias(name) for name, state in STATES.items()],
        )
    )
    df = (
        per_database.groupingSets([c.on("datname"), c.keys], *c.on("datname"))
        .agg(
            *[F.sum(n).alias(n) for n in counts],
            F.grouping("datname").cast("boolean").alias("is_total"),
        )
        .select(*c.on("datname"), *counts, "is_total")
    )
    return c.sort(df, up("is_total"), up("datname"))


def running_queries(c: Catalog) -> DataFrame:
    """Sessions that are not idle, newest statement first.

    Sessions of unknown state, and statements that look at the activity view
    itself, are left out.
    """
    df = (
        c.table("pg_stat_activity")
        .filter((F.col("state") != "idle") & ~F.col("query").ilike("%pg_stat_activity%"))
        .select(
            *c.on("datname", "pid"),
            seconds_between(F.col("query_start"), c.now).alias("age"),
            "usename", "application_name", "wait_event", "wait_event_type", "query", "query_start",
        )
    )
    return c.sort(df, down("query_start"), up("pid")).drop("query_start")


def long_transactions(c: Catalog, min_age: str = "5 minutes") -> DataFrame:
    """Working sessions whose transaction is older than ``min_age``, oldest first.

    ``min_age`` is a number and a unit, as ``5 minutes``.
    """
    limit = c.now - F.lit(min_age).cast("interval")
    df = (
        c.table("pg_stat_activity")
        .filter(
            (F.col("state") != "idle")
            & (F.col("backend_xid").isNotNull() | F.col("backend_xmin").isNotNull())
            & (F.col("xact_start") < limit)
        )
        .select(
            *c.on("state", "wait_event", "wait_event_type", "client_addr", "client_port", "application_name"),
            seconds_between(F.col("xact_start"), c.now).alias("duration"),
            "query", "xact_start", "pid",
        )
    )
    return c.sort(df, up("xact_start"), up("pid")).drop("xact_start", "pid")


def wait_events(c: Catalog) -> DataFrame:
    """Number of sessions per wait event; NULL is the group that waits for nothing."""
    df = (
        c.table("pg_stat_activity")
        .groupBy(*c.on("wait_event", "wait_event_type"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return c.sort(df, up("wait_event"), up("wait_event_type"))

"""Transaction-id age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.numbers import ratio, xid_age
from fleetlens.functions.order import down, up
from fleetlens.functions.text import human_bytes
from fleetlens.plans.levels import union_all
from fleetlens.sources.catalog import TOAST_SCHEMA, Catalog

# The id distance at which a server stops, rounded, and exact.
USABLE_XIDS = 2_000_000_000
LAST_XID_DISTANCE = (1 << 31) - 1


def _age(xid: str) -> Column:
    return xid_age(F.col("next_xid"), F.col(xid))


def _whole_percent(part: Column, whole: Column) -> Column:
    return F.bround(F.lit(100.0) * ratio(part, whole), 0)


def database_xid_age(c: Catalog) -> DataFrame:
    """Per database: age of the oldest unfrozen id, share used, ids left."""
    df = c.with_server_info(c.table("pg_database"), "next_xid")
    df = c.with_setting(df, "autovacuum_freeze_max_age", "bigint").withColumn(
        "frozen_xid_age", _age("datfrozenxid")
    )
    age = F.col("frozen_xid_age")
    df = df.select(
        *c.on("datname", "frozen_xid_age"),
        _whole_percent(age, F.lit(USABLE_XIDS)).alias("consumed_txid_pct"),
        (F.lit(LAST_XID_DISTANCE) - age).alias("remaining_txid"),
        (F.col("autovacuum_freeze_max_age") - age).alias("remaining_aggressive_vacuum"),
    )
    return c.sort(df, down("frozen_xid_age"), up("datname"))


def cluster_xid_age(c: Catalog) -> DataFrame:
    """The oldest id over the databases that accept connections, and its shares."""
    df = c.with_server_info(c.table("pg_database").filter("datallowconn"), "next_xid")
    df = c.with_setting(df, "autovacuum_freeze_max_age", "bigint").withColumn(
        "age", _age("datfrozenxid")
    )
    df = df.groupBy(*c.keys).agg(
        F.max("age").alias("oldest_current_txid"),
        F.max(_whole_percent(F.col("age"), F.lit(USABLE_XIDS))).alias("consumed_txid_pct"),
        F.max(_whole_percent(F.col("age"), F.col("autovacuum_freeze_max_age"))).alias(
            "consumed_autovac_max_age"
        ),
    )
    return c.sort(df) if c.keys else df


def oldest_relations(c: Catalog, k: int = 50) -> DataFrame:
    """The ``k`` tables, toast tables or materialized views with the oldest id.

    Per key it is a rank filter, which Spark applies in each task before the
    shuffle; without keys it is a sort with limit.
    """
    schemas = c.pick("pg_namespace", relnamespace="oid", nspname="nspname").filter(
        F.col("nspname") != TOAST_SCHEMA
    )
    df = (
        c.table("pg_class")
        .filter(F.col("relkind").isin("r", "t", "m"))
        .join(schemas, c.on("relnamespace"), "inner")
    )
    df = c.with_server_info(df, "next_xid").select(
        *c.on("oid", "relname"),
        _age("relfrozenxid").alias("age"),
        F.col("total_size"),
    )
    order = [down("age"), up("oid")]
    if c.keys:
        df = df.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*c.keys).orderBy(*order))
        ).filter(F.col("rank") <= k)
        df = c.sort(df, up("rank"))
    else:
        df = df.orderBy(*order).limit(k)
    return df.select(
        *c.keys, "relname", "age", human_bytes(F.col("total_size")).alias("total_size")
    )


def oldest_xmin_holder(c: Catalog) -> DataFrame:
    """Who holds the snapshot's xmin: the earliest session or prepared transaction.

    One row per key at most, found as the least struct: start time first, and
    no start time after every other.
    """
    fields = ["src", "xact_start", "usename", "datname", "query", "backend_xid", "backend_xmin"]
    undated = F.col("xact_start").isNull().alias("undated")
    sessions = c.table("pg_stat_activity").withColumn("src", F.lit("pg_stat_activity"))
    prepared = c.table("pg_prepared_xacts").select(
        *c.keys,
        F.lit("2pc").alias("src"),
        F.col("prepared").alias("xact_start"),
        F.col("owner").alias("usename"),
        F.col("database").alias("datname"),
        F.col("gid").alias("query"),
        F.col("transaction").alias("backend_xid"),
        F.col("transaction").alias("backend_xmin"),
    )
    candidates = sessions.select(*c.keys, *fields).unionByName(prepared)
    horizon = F.col("snapshot_xmin")
    return (
        c.with_server_info(candidates, "snapshot_xmin")
        .filter((F.col("backend_xid") == horizon) | (F.col("backend_xmin") == horizon))
        .groupBy(*c.keys)
        .agg(F.min(F.struct(undated, "xact_start", *[f for f in fields if f != "xact_start"])).alias("first"))
        .filter(F.col("first").isNotNull())
        .select(*c.keys, *[F.col(f"first.{f}").alias(f) for f in fields])
    )


#: Source name -> (view, column that holds the id).
XMIN_SOURCES = {
    "sessions": ("pg_stat_activity", "backend_xmin"),
    "prepared": ("pg_prepared_xacts", "transaction"),
    "slots": ("pg_replication_slots", "xmin"),
    "replicas": ("pg_stat_replication", "backend_xmin"),
}


def _held_xids(c: Catalog) -> DataFrame:
    """(keys, source, xid, age) over all four sources, for one aggregate pass."""
    held = union_all(
        [
            c.table(view)
            .select(*c.keys, F.lit(source).alias("source"), F.col(column).alias("xid"))
            .filter(F.col("xid").isNotNull())
            for source, (view, column) in XMIN_SOURCES.items()
        ]
    )
    return c.with_server_info(held, "next_xid").withColumn("age", _age("xid"))


def _age_of(source: str) -> Column:
    return F.when(F.col("source") == source, F.col("age"))


def oldest_xact_by_source(c: Catalog) -> DataFrame:
    """Greatest id age held by sessions, prepared transactions, slots, replicas."""
    names = {
        "oldest_running_xact": "sessions",
        "oldest_prepared_xact": "prepared",
        "oldest_replication_slot": "slots",
        "oldest_replica_xact": "replicas",
    }
    return _held_xids(c).groupBy(*c.keys).agg(
        *[F.max(_age_of(source)).alias(name) for name, source in names.items()]
    )


def xmin_horizon(c: Catalog) -> DataFrame:
    """The oldest id of each source, its age, and the greatest age of all."""
    sources = {
        "sessions": ("xmin_pg_stat_activity", "xmin_pgsa_age"),
        "slots": ("xmin_pg_replication_slots", "xmin_pgrs_age"),
        "replicas": ("xmin_pg_stat_replication", "xmin_pgsr_age"),
        "prepared": ("xmin_pg_prepared_xacts", "xmin_pgpx_age"),
    }
    return _held_xids(c).groupBy(*c.keys).agg(
        *[F.max_by("xid", _age_of(s)).alias(xid) for s, (xid, _) in sources.items()],
        *[F.max(_age_of(s)).alias(age) for s, (_, age) in sources.items()],
        F.max("age").alias("xmin_horizon_age"),
    )

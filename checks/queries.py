"""The registered queries: every report over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import FIXTURES, NOW, SETTINGS, catalog
from fleetlens import Catalog
from fleetlens.operators import (
    access, bloat, indexes, locks, partitions, replication, server, sessions, sizes, statistics,
    transactions, vacuum,
)
from fleetlens.plans.levels import ensure_checkpoint_dir, union_all
from fleetlens.sources.listing import files_of
from fleetlens.sources.publish import publish, published
from fleetlens.streaming.follow import follow_progress
from fleetlens.streaming.progress import progress_watch
from fleetlens.streaming.run import snapshot_stream, write_stream
from fleetlens.streaming.late import hours, late_files, write_hours
from fleetlens.streaming.wal import wal_hourly_watch

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Types every engine compares alike: arrays and times as text, NULL-typed as text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",", "NULL")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _report(report: Callable[..., DataFrame], keys: tuple[str, ...] = (), views: dict[str, str] | None = None, **args) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(report(catalog(spark, sf_dir, keys=keys, **(views or {})), **args))

    return run


def _profile(table: str) -> Query:
    """Sizes of a profile as aggregates of the table itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.count(F.lit(1))
        sizes_ = {
            "Relation Size": n * 64,
            "Visibility Map": F.ceil(n / 32672),
            "Free Space Map": F.ceil(n / 4096),
            "Table Included Toast Size": n * 80,
            "Indexes Size": n * 16,
            "Total Relation Size": n * 96,
        }
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return plain(sizes.table_profile(df, sizes_, live=n, dead=F.lit(0)))

    return run


def _statistics(table: str) -> Query:
    """Sketched statistics beside exact distinct counts: exact where they are exact, and
    ``distinct_ok`` where the sketch is within four standard errors."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("attname"), F.col(c).alias("exact")) for c in df.columns]))
        )
        counted = F.transform(
            F.arrays_zip("common_vals", "common_freqs"),
            lambda x: F.concat_ws(":", x["common_vals"], F.round(x["common_freqs"] * F.col("n_rows")).cast("long").cast("string")),
        )
        whole = F.col("type").isin("bigint", "int", "timestamp_ntz", "timestamp", "date")
        off = F.abs(F.col("n_distinct") - F.col("exact"))
        return plain(
            statistics.column_statistics(df).join(exact, "attname").select(
                "attnum", "attname", "n_rows", "null_frac", "avg_width", F.col("exact").alias("n_distinct"),
                (off <= F.ceil(4 * statistics.DISTINCT_ERROR * F.col("exact"))).alias("distinct_ok"),
                F.when(whole, F.get("histogram_bounds", F.lit(0))).alias("lowest"),
                F.when(whole, F.element_at("histogram_bounds", -1)).alias("highest"),
                F.when(F.col("exact") <= 10, F.array_join(counted, ",")).alias("common"),
            )
        )

    return run


#: Tables whose space is estimated from their own rows, and the rows a page of each holds.
MEASURED = {"orders": 20, "lineitem": 12, "documents": 2, "part": 90, "customer": 400}


def _measured_bloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bloat of plain tables, from statistics measured on them."""
    tables = {t: (spark.read.parquet(f"{sf_dir}/{t}.parquet"), F.ceil(F.col("n_rows") / n)) for t, n in MEASURED.items()}
    views = statistics.measured_views(tables)
    rows = ", ".join(f"('{k}', '{v}')" for k, v in SETTINGS.items())
    views["settings"] = spark.sql(f"select * from values {rows} as t(name, setting)")
    views["server_info"] = spark.sql("select 'db0' as current_database")
    return plain(bloat.bloat_estimates(Catalog(views, keys=(), now=F.lit(NOW).cast("timestamp"))))


def _standby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(
        replication.standby_state(
            catalog(spark, sf_dir, keys=("cluster_id",), server_info="standby_info")
        )
    )


CLUSTER = {"keys": ("cluster_id",), "views": {"settings": "cluster_settings", "server_info": "cluster_info"}}

QUERIES: dict[str, Query] = {
    "r01_relation_sizes": _report(sizes.relation_sizes),
    "r01_relation_sizes_of_schema": _report(sizes.relation_sizes, schema="public"),
    "r02_relation_constraints": _report(sizes.relation_constraints),
    "r03_index_columns": _report(indexes.index_columns),
    "r04_toast_tables": _report(sizes.toast_tables),
    "r05_column_storage": _report(sizes.column_storage),
    "r06_toast_of_relation": _report(sizes.toast_of_relation),
    "r07_table_profile_orders": _profile("orders"),
    "r07_table_profile_documents": _profile("documents"),
    "r07_column_statistics_orders": _statistics("orders"),
    "r07_column_statistics_lineitem": _statistics("lineitem"),
    "r07_column_statistics_documents": _statistics("documents"),
    "r08_bloat_of_measured_tables": _measured_bloat,
    "r08_tables_without_stats": _report(bloat.tables_without_stats),
    "r08_row_shapes": _report(bloat.row_shapes),
    "r08_bloat_estimates": _report(bloat.bloat_estimates),
    "r08_relation_bloat": _report(bloat.relation_bloat),
    "r09_index_key_widths": _report(bloat.index_key_widths),
    "r09_index_bloat": _report(bloat.index_bloat),
    "r10_duplicate_indexes": _report(indexes.duplicate_indexes),
    "r10_contained_indexes": _report(indexes.contained_indexes),
    "r11_index_usage": _report(indexes.index_usage),
    "r12_index_state": _report(indexes.index_state),
    "r12_index_state_of_schema": _report(indexes.index_state, schema="public", keep_unindexed=True),
    "r13_index_summary": _report(indexes.index_summary),
    "r13_index_summary_faithful": _report(indexes.index_summary, faithful=True),
    "r14_unused_indexes": _report(indexes.unused_indexes),
    "r15_high_null_indexes": _report(indexes.high_null_indexes),
    "r16_index_build_progress": _report(indexes.index_build_progress),
    "r17_lock_pairs": _report(locks.lock_pairs),
    "r17_lock_pairs_granted": _report(locks.lock_pairs, require_granted=True),
    "r17_lock_classes": _report(locks.lock_classes),
    "r17_lock_classes_granted": _report(locks.lock_classes, require_granted=True),
    "r17_class_pairs": _report(lambda c: locks.class_pairs(c, locks.lock_classes(c).filter("n_pairs > 0"))),
    "r17_top_blockers": _report(locks.top_blockers),
    "r18_lock_report": _report(locks.lock_report),
    "r19_lock_wait_queue": _report(locks.lock_wait_queue, views={"pg_locks": "locks_chain"}),
    "r19_deadlocks": _report(locks.deadlocks, views={"pg_locks": "locks_ring"}),
    "r20_lock_tree": _report(locks.lock_tree, views={"pg_locks": "locks_chain"}),
    "r21_connection_summary": _report(sessions.connection_summary),
    "r22_running_queries": _report(sessions.running_queries),
    "r23_long_transactions": _report(sessions.long_transactions),
    "r24_wait_events": _report(sessions.wait_events),
    "r25_database_xid_age": _report(transactions.database_xid_age),
    "r26_cluster_xid_age": _report(transactions.cluster_xid_age),
    "r27_oldest_relations": _report(transactions.oldest_relations),
    "r28_oldest_xmin_holder": _report(transactions.oldest_xmin_holder),
    "r29_oldest_xact_by_source": _report(transactions.oldest_xact_by_source),
    "r30_xmin_horizon": _report(transactions.xmin_horizon),
    "r31_vacuum_progress": _report(vacuum.vacuum_progress),
    "r32_vacuum_needed": _report(vacuum.vacuum_needed),
    "r33_vacuum_queue": _report(vacuum.vacuum_queue),
    "r34_database_status": _report(server.database_status),
    "r34_database_status_v13": _report(server.database_status, version=13),
    "r34_database_status_v11": _report(server.database_status, version=11),
    "r35_checkpoint_stats": _report(server.checkpoint_stats, **CLUSTER),
    "r36_wal_archive_state": _report(server.wal_archive_state, **CLUSTER),
    "r37_wal_hourly": _report(server.wal_hourly),
    "r38_wal_stats": _report(server.wal_stats, **CLUSTER),
    "r39_replication_lag_time": _report(replication.replication_lag_time),
    "r40_replication_lag_bytes": _report(replication.replication_lag_bytes),
    "r41_standby_state": _standby,
    "r42_objects_owned_by": _report(access.objects_owned_by),
    "r43_role_paths": _report(access.role_paths),
    "r43_role_memberships": _report(access.role_memberships),
    "r43_role_memberships_of_chains": _report(access.role_memberships, views={"pg_auth_members": "role_chains"}),
    "r44_effective_privileges": _report(access.effective_privileges),
    "r45_view_dependencies": _report(access.view_dependencies),
    "r46_partition_tree": _report(partitions.partition_tree),
    "r46_partition_tree_to_depth": _report(partitions.partition_tree, depth=2),
    "r47_inherit_children": _report(partitions.inherit_children),
    "r48_partition_totals": _report(partitions.partition_totals),
    "r48_partition_sizes": _report(partitions.partition_sizes),
    "r48_partition_sizes_of_database": _report(partitions.partition_sizes, database="nation_3"),
}


def _run_stream(watch: Callable[..., DataFrame], view: Callable[[DataFrame], DataFrame], **args) -> Query:
    """Follow the events as a stream of files and give what was written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        stream = snapshot_stream(spark, sf_dir, schema, glob="events.parquet")
        folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
        df = watch(view(stream), keys=(), **args)
        write_stream(df, f"{folder}/rows", f"{folder}/state").awaitTermination()
        return plain(spark.read.schema(df.schema).parquet(f"{folder}/rows"))

    return run


def as_progress(events: DataFrame) -> DataFrame:
    """Events as progress snapshots: each user is a session that scans blocks."""
    return events.select(
        F.col("ts").alias("snapshot_ts"),
        F.col("user_id").alias("pid"),
        F.col("event_type").alias("phase"),
        F.col("event_id").alias("heap_blks_scanned"),
        (F.col("event_id") * 2 + 100).alias("heap_blks_total"),
    )


def as_polls(events: DataFrame) -> DataFrame:
    """Events as polls of commands that stand still now and then."""
    return events.select(
        F.col("ts").alias("snapshot_ts"),
        F.col("user_id").alias("pid"),
        F.when(F.col("event_type").isin("view", "click", "error"), "scanning").otherwise("vacuuming").alias("phase"),
        F.expr("cast(floor(value / 20) as bigint)").alias("heap_blks_scanned"),
        (F.col("event_id") * 2 + 100).alias("heap_blks_total"),
    )


def as_wal_files(events: DataFrame) -> DataFrame:
    return FIXTURES["wal_files"].frame(events)


FLEET = {
    "keys": ("cluster_id",),
    "views": {
        "pg_stat_activity": "fleet_activity", "pg_class": "fleet_class", "pg_namespace": "fleet_namespace",
        "server_info": "fleet_info",
    },
}
QUERIES["r21_connection_summary_by_cluster"] = _report(sessions.connection_summary, **FLEET)
QUERIES["r24_wait_events_by_cluster"] = _report(sessions.wait_events, **FLEET)
QUERIES["r27_oldest_relations_by_cluster"] = _report(transactions.oldest_relations, **FLEET, k=20)
QUERIES["st1_progress_watch"] = _run_stream(
    progress_watch, as_progress, window="6 hours", delay="10 minutes"
)
QUERIES["st2_wal_hourly_watch"] = _run_stream(wal_hourly_watch, as_wal_files)
QUERIES["st1_progress_follow"] = _run_stream(
    follow_progress, as_polls, last=5, stall_after="4 hours", expire_after="20 hours", delay="10 minutes"
)


def _late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries, two of them mostly late: counts on time, and those of the late files."""
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for delivery in range(3):
        events.filter(F.col("event_id") % 3 == delivery).coalesce(1).write.parquet(f"{folder}/in/delivery={delivery}")
    stream = snapshot_stream(spark, f"{folder}/in/*", events.schema, files_per_batch=1)
    target = f"{folder}/hours"
    write_hours(as_wal_files(stream), target, f"{folder}/state", keys=()).awaitTermination()
    late = late_files(spark, target).groupBy(*HOUR).agg(F.count("*").alias("late_num"))
    return plain(
        hours(spark, target).join(late, HOUR, "full").select(*HOUR, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("wal_num", "late_num")])
    )


HOUR = ["day_id", "hour"]
QUERIES["st2_wal_hourly_late"] = _late_files
QUERIES["s3_table_files"] = lambda spark, sf_dir: plain(files_of(spark, sf_dir, "*.parquet", recursive=True))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lock bundle, published twice: what a reader of the newest version finds."""
    root = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    c = catalog(spark, sf_dir, pg_locks="locks_chain")
    reports = {"lock_wait_queue": locks.lock_wait_queue(c), "lock_pairs": locks.lock_pairs(c), "wait_events": sessions.wait_events(c)}
    publish({name: df.limit(0) for name, df in reports.items()}, root)
    publish(reports, root)
    found = published(spark, root)
    counts = [df.agg(F.lit(name).alias("report"), F.count("*").alias("n")) for name, df in found.items()]
    return union_all(counts)


QUERIES["s7_lock_bundle_published"] = _published

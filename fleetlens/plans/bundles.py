"""The reports that belong together, by command name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fleetlens.operators import (
    access, bloat, indexes, locks, partitions, replication, server, sessions, sizes, transactions,
    vacuum,
)
from fleetlens.sources.catalog import Catalog

Report = Callable[..., DataFrame]

# Command -> its reports. The value of a report names the bundle arguments it
# takes.
BUNDLES: dict[str, list[tuple[str, Report, tuple[str, ...]]]] = {
    "relation": [("relation_sizes", sizes.relation_sizes, ("schema",))],
    "relconstraint": [
        ("relation_constraints", sizes.relation_constraints, ("table",)),
        ("index_columns", indexes.index_columns, ("table",)),
    ],
    "alltoast": [("toast_tables", sizes.toast_tables, ("schema",))],
    "reltoast": [
        ("column_storage", sizes.column_storage, ("table",)),
        ("toast_of_relation", sizes.toast_of_relation, ("table",)),
    ],
    "dbstatus": [("database_status", server.database_status, ("version",))],
    "lock": [
        ("lock_wait_queue", locks.lock_wait_queue, ()),
        ("lock_pairs", locks.lock_pairs, ()),
        ("lock_report", locks.lock_report, ("max_depth", "shown")),
    ],
    "checkpoint": [("checkpoint_stats", server.checkpoint_stats, ())],
    "freeze": [
        ("database_xid_age", transactions.database_xid_age, ()),
        ("cluster_xid_age", transactions.cluster_xid_age, ()),
        ("oldest_relations", transactions.oldest_relations, ("k",)),
    ],
    "connections": [
        ("connection_summary", sessions.connection_summary, ()),
        ("running_queries", sessions.running_queries, ()),
    ],
    "index_bloat": [("index_bloat", bloat.index_bloat, ())],
    "index_duplicate": [("duplicate_indexes", indexes.duplicate_indexes, ())],
    "index_low": [("index_usage", indexes.index_usage, ())],
    "index_state": [
        ("index_state", indexes.index_state, ("schema",)),
        ("index_summary", indexes.index_summary, ("schema",)),
    ],
    "long_transaction": [("long_transactions", sessions.long_transactions, ("min_age",))],
    "relation_bloat": [
        ("relation_bloat", bloat.relation_bloat, ("rules",)),
        ("oldest_xmin_holder", transactions.oldest_xmin_holder, ()),
        ("oldest_xact_by_source", transactions.oldest_xact_by_source, ()),
    ],
    "vacuum_state": [("vacuum_progress", vacuum.vacuum_progress, ())],
    "vacuum_need": [
        ("vacuum_needed", vacuum.vacuum_needed, ("base_threshold", "scale_factor"))
    ],
    "wait_event": [("wait_events", sessions.wait_events, ())],
    "wal_archive": [("wal_archive_state", server.wal_archive_state, ())],
    "wal_generate": [
        ("wal_hourly", server.wal_hourly, ()),
        ("wal_stats", server.wal_stats, ()),
    ],
    "replication": [("replication_lag", replication.replication_lag, ("version",))],
    "index_create": [("index_build_progress", indexes.index_build_progress, ())],
    "object": [
        ("objects_owned_by", access.objects_owned_by, ("role",)),
        ("role_paths", access.role_paths, ("min_role_id",)),
    ],
    "partition": [
        ("partition_tree", partitions.partition_tree, ()),
        ("inherit_children", partitions.inherit_children, ()),
        ("partition_sizes", partitions.partition_sizes, ("database",)),
    ],
}

#: Counters that only exist from this server version on.
WAL_STATS_SINCE = 15


def bundle(c: Catalog, command: str, version: int = WAL_STATS_SINCE, **args: object) -> dict[str, DataFrame]:
    """The reports of a command as DataFrames, by report name.

    All of them see the same snapshots. ``version`` is the server's major
    version; other arguments go to the reports that take them.
    """
    if command not in BUNDLES:
        raise ValueError(f"unknown command {command!r}; known: {', '.join(BUNDLES)}")
    reports = BUNDLES[command]
    known = {name for _, _, names in reports for name in names}
    if set(args) - known:
        raise TypeError(f"{command} does not take {sorted(set(args) - known)}")
    given = {**args, "version": version}
    return {
        name: report(c, **{n: given[n] for n in names if n in given})
        for name, report, names in reports
        if not (name == "wal_stats" and version < WAL_STATS_SINCE)
    }

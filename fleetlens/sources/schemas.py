"""Columns of each exported view: one superset over all server versions.

A column an old export lacks reads as NULL. Sizes, definition texts and names
that only a live server can compute arrive as columns of the export.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "pg_namespace": "oid bigint, nspname string",
    "pg_class": """oid bigint, relname string, relnamespace bigint, relkind string,
        relowner bigint, relfilenode bigint, reltuples double, relpages bigint,
        reltoastrelid bigint, relispartition boolean, relfrozenxid bigint, relopts string,
        relpartbound string, relation_size bigint, indexes_size bigint, table_size bigint,
        total_size bigint""",
    "pg_inherits": "inhrelid bigint, inhparent bigint",
    "pg_partitioned_table": "partrelid bigint, partstrat string, partexprs string",
    "pg_attribute": """relid bigint, attnum int, attisdropped boolean, attname string, attstorage string,
        atttypid bigint""",
    "pg_type": "oid bigint, typname string",
    "pg_stats": "relid bigint, attname string, null_frac double, avg_width bigint",
    "pg_stat_user_tables": """relid bigint, relname string, n_live_tup bigint,
        n_dead_tup bigint, n_tup_ins bigint, n_tup_upd bigint, n_tup_del bigint,
        seq_scan bigint, idx_scan bigint, autovacuum_count bigint, last_vacuum timestamp,
        last_autovacuum timestamp""",
    "pg_index": """indexrelid bigint, indrelid bigint, indexname string, indkey string,
        indclass string, indexprs string, indpred string, indnatts int,
        indisunique boolean, indisprimary boolean, amname string, idx_scan bigint,
        idx_tup_read bigint, idx_tup_fetch bigint, reltuples double, relpages bigint,
        index_bytes bigint""",
    "pg_roles": "oid bigint, rolname string, rolsuper boolean",
    "pg_auth_members": "member bigint, roleid bigint",
    "table_grants": "relid bigint, grantee bigint, perm string",
    "pg_database": """oid bigint, datname string, datdba bigint, datfrozenxid bigint,
        datallowconn boolean, database_size bigint""",
    "pg_stat_database": """datid bigint, datname string, blks_hit bigint, blks_read bigint,
        xact_commit bigint, xact_rollback bigint, conflicts bigint, temp_files bigint,
        temp_bytes bigint, deadlocks bigint, checksum_failures bigint,
        blk_read_time double, blk_write_time double, session_time double,
        active_time double, idle_in_transaction_time double, sessions bigint,
        sessions_abandoned bigint, sessions_fatal bigint, sessions_killed bigint""",
    "pg_stat_activity": """pid bigint, datname string, usename string,
        application_name string, client_addr string, client_port int, state string,
        wait_event string, wait_event_type string, query_start timestamp,
        xact_start timestamp, state_change timestamp, backend_xid bigint,
        backend_xmin bigint, query string""",
    "pg_locks": """pid bigint, granted boolean, mode string, locktype string,
        database bigint, relation bigint, page bigint, tuple bigint, virtualxid string,
        transactionid bigint, classid bigint, objid bigint, objsubid bigint""",
    "pg_stat_replication": """client_addr string, usename string, application_name string,
        state string, sync_state string, current_lsn string, sent_lsn string,
        write_lsn string, flush_lsn string, replay_lsn string, write_lag double,
        flush_lag double, replay_lag double, backend_xmin bigint""",
    "pg_prepared_xacts": """transaction bigint, gid string, prepared timestamp,
        owner string, database string""",
    "pg_replication_slots": "slot_name string, xmin bigint",
    "pg_stat_progress_vacuum": """pid bigint, datname string, relid bigint, phase string,
        heap_blks_total bigint, heap_blks_scanned bigint, heap_blks_vacuumed bigint,
        index_vacuum_count bigint, num_dead_tuples bigint, max_dead_tuples bigint""",
    "pg_stat_progress_create_index": """pid bigint, relid bigint, index_relid bigint,
        phase string, current_locker_pid bigint, lockers_done bigint,
        lockers_total bigint, blocks_done bigint, blocks_total bigint,
        tuples_done bigint, tuples_total bigint, partitions_done bigint,
        partitions_total bigint""",
    "wal_files": "file_ls string, size bigint, modification timestamp",
    "pg_stat_bgwriter": """checkpoints_timed bigint, checkpoints_req bigint,
        buffers_clean bigint, buffers_checkpoint bigint, buffers_backend bigint,
        buffers_backend_fsync bigint""",
    "pg_stat_archiver": """archived_count bigint, last_archived_wal string,
        last_archived_time timestamp, failed_count bigint, last_failed_wal string,
        last_failed_time timestamp, stats_reset timestamp""",
    "pg_stat_wal": """wal_records bigint, wal_fpi bigint, wal_bytes bigint,
        wal_buffers_full bigint, wal_write bigint, wal_sync bigint,
        wal_write_time double, wal_sync_time double, stats_reset timestamp""",
    "pg_depend": "view_oid bigint, refobjid bigint, refobjsubid int",
    "pg_constraint": """conname string, conrelid bigint, column_name string,
        cons_def string""",
    "settings": "name string, setting string",
    "server_info": """next_xid bigint, snapshot_xmin bigint, current_database string,
        postmaster_start timestamp, in_recovery boolean, receive_lsn string,
        replay_lsn string, last_replay_time timestamp""",
}

#: Partition column of landed snapshots and the key columns every view carries.
PARTITION = "snapshot_date"
KEYS = {"cluster_id": "string", "snapshot_ts": "timestamp"}


def view_columns(view: str) -> dict[str, str]:
    """Column name -> type of a view."""
    return dict(column.split() for column in VIEWS[view].split(","))

"""One small case per meaning that is easy to get wrong."""

from __future__ import annotations

import datetime as dt

from fleetlens.operators import (
    access, bloat, indexes, locks, partitions, replication, server, sessions as s, sizes, transactions, vacuum,
)
from tests.helpers import lock, sessions, small_catalog, values


def table(oid, name, nsp=1, kind="r", **more):
    return {"oid": oid, "relname": name, "relnamespace": nsp, "relkind": kind, "reltuples": 0.0, "relpages": 0,
            "reltoastrelid": 0, "relispartition": False, "relfilenode": oid, "relation_size": 0, "table_size": 0,
            "total_size": 0, "indexes_size": 0, **more}


def test_zero_checkpoints_and_integer_average(spark):
    row = {"checkpoints_timed": 0, "checkpoints_req": 0, "buffers_clean": 1, "buffers_checkpoint": 5, "buffers_backend": 2,
           "buffers_backend_fsync": 0}
    info = {"postmaster_start": dt.datetime(2024, 1, 31, 22), "cluster_id": 1}
    c = small_catalog(spark, ("cluster_id",), pg_stat_bgwriter=[{**row, "cluster_id": 1}, {**row, "cluster_id": 2, "checkpoints_req": 3}],
                      settings=[{"name": "block_size", "setting": "8192", "cluster_id": i} for i in (1, 2)],
                      server_info=[info, {**info, "cluster_id": 2}])
    rows = values(server.checkpoint_stats(c), "cluster_id", "checkpoint_write_avg", "minutes_between_checkpoints")
    assert rows == [(1, None, None), (2, "13 kB", 40.0)]


def test_zero_commits_and_templates(spark):
    c = small_catalog(spark, pg_stat_database=[
        {"datid": 1, "datname": "a", "blks_hit": 2, "blks_read": 1, "xact_commit": 0, "xact_rollback": 0},
        {"datid": 2, "datname": "b", "blks_hit": 0, "blks_read": 0, "xact_commit": 1, "xact_rollback": 0},
        {"datid": 3, "datname": "template1", "blks_hit": 1, "blks_read": 0, "xact_commit": 1, "xact_rollback": 0},
    ])
    assert values(server.database_status(c), "database_name", "cache_hit_ratio", "commit_ratio") == [("a", "66 %", None)]
    assert values(server.database_status(c, version=12), "cache_hit_ratio") == ["66%"]
    assert "sessions" not in server.database_status(c, version=14).columns
    assert "checksum_failures" not in server.database_status(c, version=14).columns


def test_lag_parts_are_rounded_and_the_total_is_cut(spark):
    c = small_catalog(spark, pg_stat_replication=[{"client_addr": "a", "current_lsn": "0/A00", "sent_lsn": "0/400",
                                                   "write_lsn": "0/400", "flush_lsn": "0/200", "replay_lsn": "0/0"}])
    df = replication.replication_lag_bytes(c)
    assert values(df, "pending", "write", "flush", "replay", "total_lag") == [(2, 0, 1, 1, 2)]
    assert replication.replication_lag(c, version=9).columns == df.columns
    assert "write_lag" in replication.replication_lag(c, version=12).columns


def test_zero_block_vacuum_and_missing_wait(spark):
    c = small_catalog(
        spark,
        pg_stat_progress_vacuum=[{"pid": 1, "relid": 9, "heap_blks_total": 0, "heap_blks_scanned": 0, "heap_blks_vacuumed": 0,
                                  "num_dead_tuples": 1, "max_dead_tuples": 3}],
        pg_stat_activity=[{"pid": 1, "query": "VACUUM t", "wait_event": "x"}],
    )
    assert values(vacuum.vacuum_progress(c), "scanned_pct", "dead_pct", "waiting", "mode", "table", "duration") == [
        (None, 33.3, "f", "user", "9", None)]


def test_unknown_state_is_not_running_but_can_block(spark):
    c = small_catalog(
        spark,
        pg_stat_activity=[*sessions(1, state=None), *sessions(2), *sessions(3, state="idle")],
        pg_locks=[lock(1, 10, True), lock(2, 10, False), lock(3, 11, True), lock(2, 12, True)],
    )
    assert values(s.running_queries(c), "pid") == [2]
    assert values(locks.lock_tree(c), "pid", "level", "state") == [(1, 1, None), (2, 2, "active")]


def test_sessions_without_a_database_are_not_the_total(spark):
    c = small_catalog(spark, pg_stat_activity=[*sessions(1, datname="d"), *sessions(2, state="idle")])
    assert values(s.connection_summary(c), "datname", "open", "active", "idle", "is_total") == [
        ("d", 1, 1, 0, False), (None, 1, 0, 1, False), (None, 2, 1, 1, True)]


def test_table_without_index_has_none(spark):
    c = small_catalog(spark, pg_class=[table(10, "bare"), table(11, "one")],
                      pg_index=[{"indexrelid": 5, "indrelid": 11, "indisunique": True, "indnatts": 1}])
    count = ("table", "total_indexes", "unique_indexes", "single_column_indexes", "multi_column_indexes")
    assert values(indexes.index_summary(c), *count) == [("one", 1, 1, 1, 0), ("bare", 0, 0, 0, 0)]
    assert values(indexes.index_summary(c, faithful=True), *count) == [("one", 1, 1, 1, 0), ("bare", 1, 0, 0, 1)]


def test_same_name_in_two_schemas_does_not_multiply(spark):
    c = small_catalog(
        spark,
        pg_class=[table(10, "t", nsp=1, reltuples=100.0), table(11, "t", nsp=2, reltuples=1000.0)],
        pg_stat_user_tables=[{"relid": 10, "relname": "t", "n_dead_tup": 100}, {"relid": 11, "relname": "t", "n_dead_tup": 100}],
    )
    assert values(vacuum.vacuum_needed(c), "vacuum_threshold", "is_vacuum") == [(60.0, True), (150.0, False)]
    assert values(vacuum.vacuum_needed(c, base_threshold=0, scale_factor=0.01), "is_vacuum") == [True, True]


def queue(spark, **tables):
    return vacuum.vacuum_queue(small_catalog(spark, **tables))


def test_vacuum_queue_settings_labels_and_foreign_vacuum(spark):
    stats = {"relid": 10, "n_dead_tup": 1000}
    df = queue(
        spark,
        pg_class=[table(10, "t", reltuples=100.0, relopts="autovacuum_enabled=offautovacuum_vacuum_threshold=7fillfactor=90"),
                  table(11, "u", nsp=2, reltuples=100.0), table(12, "calm", reltuples=100.0)],
        pg_stat_user_tables=[
            {**stats, "last_vacuum": dt.datetime(2024, 1, 2), "last_autovacuum": dt.datetime(2024, 1, 1)},
            {"relid": 11, "n_dead_tup": 0, "last_autovacuum": dt.datetime(2024, 1, 1)}, {"relid": 12, "n_dead_tup": 1}],
        pg_stat_progress_vacuum=[
            {"pid": 1, "datname": "Other", "relid": 10, "phase": "scanning heap", "heap_blks_total": 0, "heap_blks_scanned": 0},
            {"pid": 2, "datname": "db0", "relid": 11, "phase": "scanning heap", "heap_blks_total": 8, "heap_blks_scanned": 1}],
        pg_stat_activity=[{"pid": 2, "query": "autovacuum: VACUUM u (to prevent wraparound)"}],
        pg_index=[{"indexrelid": 1, "indrelid": 11}, {"indexrelid": 2, "indrelid": 11}],
    )
    assert values(df, "relation", "status", "effective_settings", "last_vacuumed", "mode", "waiting", "scanned_pct", "index_count") == [
        ('[something in ""Other""]', "scanning heap", "vt: , vsf: , enabled", None, None, None, None, None),
        ("app.u", "scanning heap", "vt: 50, vsf: 0.2, enabled", "2024-01-01 00:00:00 (auto)", "wraparound", "f", 12.5, 2),
        ("t", "~~~ in queue ~~~", "vt: 7, vsf: 0.2, DISABLED", "2024-01-02 00:00:00 (manual)", None, None, None, None),
    ]


def test_archive_mode_always_is_on(spark):
    wal = {"archived_count": 10, "last_archived_wal": "0B", "stats_reset": dt.datetime(2024, 1, 31, 23, 59, 50)}
    rows = [{**wal, "cluster_id": 1}, {**wal, "cluster_id": 2, "last_failed_wal": "0C"}, {**wal, "cluster_id": 3, "last_failed_wal": "0A"},
            {**wal, "cluster_id": 4, "stats_reset": dt.datetime(2024, 2, 1)}]
    c = small_catalog(spark, ("cluster_id",), pg_stat_archiver=rows,
                      settings=[{"name": "archive_mode", "setting": "off" if i == 4 else "always", "cluster_id": i} for i in (1, 2, 3, 4)])
    assert values(server.wal_archive_state(c), "is_archiving", "current_archived_wals_per_second") == [
        (True, 1.0), (False, 1.0), (True, 1.0), (False, None)]


def test_partition_strategies_and_two_roots(spark):
    c = small_catalog(
        spark,
        pg_class=[table(1, "h", kind="p"), table(2, "l", kind="p"), table(3, "child"), table(4, "leaf", relpartbound="FOR 1")],
        pg_inherits=[{"inhrelid": 3, "inhparent": 1}, {"inhrelid": 3, "inhparent": 2}, {"inhrelid": 4, "inhparent": 3}],
        pg_partitioned_table=[{"partrelid": 1, "partstrat": "h"}, {"partrelid": 2, "partstrat": "l"}],
    )
    rows = values(partitions.partition_tree(c), "table_name", "partitioning_type", "table_parent_name", "level", "partitioning_values")
    assert sorted(rows, key=str) == [
        ("child", "not partitioned", "h", 1, None), ("child", "not partitioned", "l", 1, None), ("h", "BY HASH", None, 0, None),
        ("l", "BY LIST", None, 0, None), ("leaf", "not partitioned", "child", 2, "FOR 1"), ("leaf", "not partitioned", "child", 2, "FOR 1"),
    ]


def test_object_kinds(spark):
    c = small_catalog(spark, pg_roles=[{"oid": 7, "rolname": "me"}],
                      pg_class=[table(i, k, kind=k, relowner=7) for i, k in enumerate("rmiSvcp", 1)] + [table(9, "other", relowner=8),
                                table(10, "hidden", nsp=3, relowner=7)])
    kinds = dict(values(access.objects_owned_by(c, "me"), "objectname", "objecttype"))
    assert kinds == {"r": "TABLE", "m": "MATERIALIZED_VIEW", "i": "INDEX", "S": "SEQUENCE", "v": "VIEW", "c": "TYPE", "p": "p"}


def test_built_in_roles_cut_only_the_first_step(spark):
    c = small_catalog(spark, pg_roles=[{"oid": o, "rolname": n} for o, n in [(20000, "a"), (20001, "b"), (10, "monitor")]],
                      pg_auth_members=[{"member": 20000, "roleid": 20001}, {"member": 20001, "roleid": 10}])
    assert values(access.role_paths(c), "role", "path") == [("b", "a -> b"), ("monitor", "a -> b -> monitor")]
    assert sorted(values(access.role_paths(c, min_role_id=0), "path")) == ["a -> b", "a -> b -> monitor", "b -> monitor"]


def test_role_cycles_end(spark):
    c = small_catalog(spark, pg_roles=[{"oid": 20000 + i, "rolname": f"r{i}"} for i in range(3)],
                      pg_auth_members=[{"member": 20000 + i, "roleid": 20000 + (i + 1) % 3} for i in range(3)])
    assert access.role_paths(c).count() == 6
    assert access.role_closure(c).count() == 6


def test_privileges_by_grant_owner_membership_and_for_all(spark):
    c = small_catalog(
        spark,
        pg_class=[table(1, "t", relowner=30)], pg_roles=[{"oid": o, "rolname": n, "rolsuper": n == "root"} for o, n in
                                                         [(30, "owner"), (31, "group"), (32, "member"), (33, "root"), (34, "nobody")]],
        pg_auth_members=[{"member": 32, "roleid": 31}],
        table_grants=[{"relid": 1, "grantee": 31, "perm": "SELECT"}, {"relid": 1, "grantee": 32, "perm": "SELECT"},
                      {"relid": 1, "grantee": 32, "perm": "UPDATE"}, {"relid": 1, "grantee": 0, "perm": "TRIGGER"}],
    )
    rows = values(access.effective_privileges(c), "user_name", "table_name", "privilege_type")
    assert [r for r in rows if r[0] != "owner"] == [
        ("PUBLIC", "t", "TRIGGER"), ("group", "t", "SELECT"), ("member", "t", "SELECT"), ("member", "t", "UPDATE"), ("root", "*", "ALL")]
    assert [r[2] for r in rows if r[0] == "owner"] == sorted(access.TABLE_PRIVILEGES)


def test_duplicate_indexes_by_definition(spark):
    def index(i, **more):
        return {"indexrelid": i, "indrelid": 10, "indexname": f"i{i}", "indkey": "1", "index_bytes": 100, **more}

    c = small_catalog(spark, pg_class=[table(10, "t")], pg_index=[
        *[index(i) for i in (5, 4, 3, 2, 1)], index(6, indpred="x > 0"), index(7, indpred="x > 0"), index(8, indkey="2"), index(9, indclass="c")])
    assert values(indexes.duplicate_indexes(c), "table", "n", "size", "idx1", "idx4") == [
        ("public.t", 5, "500 bytes", "i1", "i4"), ("public.t", 2, "200 bytes", "i6", None)]


def test_expression_index_has_its_own_statistics(spark):
    c = small_catalog(
        spark, pg_class=[table(10, "t", relation_size=1 << 20)],
        pg_attribute=[{"relid": 10, "attnum": 1, "attname": "a"}, {"relid": 5, "attnum": 2, "attname": "lower"}],
        pg_stats=[{"relid": 10, "attname": "a", "null_frac": 0.5, "avg_width": 8}, {"relid": 5, "attname": "lower", "null_frac": 0.0, "avg_width": 5}],
        pg_index=[{"indexrelid": 5, "indrelid": 10, "indexname": "i", "indkey": "1 0", "amname": "btree", "relpages": 100, "reltuples": 1000.0, "idx_scan": 1}],
    )
    assert values(bloat.index_key_widths(c), "tuple_header", "key_width") == [(6, 9.0)]
    # 6 + 2 + 9 + 7 = 24 bytes a tuple, 1000 of them on 8168 byte pages, and one more.
    assert values(bloat.index_bloat(c), "bloat_mb", "bloat_pct", "total_mb") == [(1.0, 96.0, 0.781)]


def test_bloat_rules_are_parameters(spark):
    c = small_catalog(
        spark, pg_class=[table(10, "t", relpages=10000, reltuples=1000.0)], pg_stat_user_tables=[{"relid": 10, "n_live_tup": 5}],
        pg_attribute=[{"relid": 10, "attnum": 1, "attname": "a"}], pg_stats=[{"relid": 10, "attname": "a", "null_frac": 0.0, "avg_width": 8}])
    assert values(bloat.relation_bloat(c), "tablename", "pct_bloat", "mb_bloat") == [("t", 100.0, 78.09)]
    assert bloat.relation_bloat(c, rules=[(50, 100)]).isEmpty()


def test_toast_and_negative_table_bytes(spark):
    c = small_catalog(spark, pg_class=[table(10, "t", reltoastrelid=11, total_size=10, indexes_size=5), table(11, "toast", nsp=3, kind="t", total_size=50, relation_size=40)])
    assert values(sizes.relation_sizes(c, "public"), "table_bytes", "table", "has_been_rewrite") == [(-45, "-45 bytes", "NO")]
    assert values(sizes.toast_tables(c, "public"), "relname", "toast_name", "toast_size") == [("t", "toast", 40)]
    assert sizes.toast_tables(c, "app").isEmpty()
    assert values(sizes.toast_of_relation(c, "t"), "schema", "toast_name") == [("public", "toast")]


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    rows = values(sizes.table_profile(df, {"Relation Size": 100}, live=1, dead=2), "description", "bytes", "bytes_per_row")
    assert rows == [("Relation Size", 100, None), ("Live Row Byte Size", None, None), ("-" * 30, None, None),
                    ("TotalRows", 0, None), ("LiveTuples", 1, None), ("DeadTuples", 2, None)]


def test_xmin_holder_prefers_dated_rows(spark):
    c = small_catalog(
        spark, pg_stat_activity=[{"pid": 1, "backend_xmin": 3, "usename": "undated"}, {"pid": 2, "backend_xid": 3, "xact_start": dt.datetime(2024, 1, 5), "usename": "late"}],
        pg_prepared_xacts=[{"transaction": 3, "gid": "g", "prepared": dt.datetime(2024, 1, 2), "owner": "early"}])
    assert values(transactions.oldest_xmin_holder(c), "src", "usename", "query") == [("2pc", "early", "g")]
    assert transactions.oldest_xmin_holder(small_catalog(spark)).isEmpty()


def test_top_relations_per_cluster(spark):
    rows = [table(i, f"t{i}", relfrozenxid=1000 - i, cluster_id=k) for k in (1, 2) for i in range(10)]
    c = small_catalog(spark, ("cluster_id",), pg_class=rows, pg_namespace=[{"oid": 1, "nspname": "public", "cluster_id": k} for k in (1, 2)],
                      server_info=[{"next_xid": 5000, "cluster_id": k} for k in (1, 2)])
    assert values(transactions.oldest_relations(c, k=2), "cluster_id", "relname", "age") == [
        (1, "t9", 4009), (1, "t8", 4008), (2, "t9", 4009), (2, "t8", 4008)]


def test_wal_hours_add_up(spark):
    at = [dt.datetime(2024, 1, d, h, 30) for d, h in [(1, 0), (1, 23), (1, 23), (2, 5)]]
    c = small_catalog(spark, wal_files=[{"file_ls": str(i), "modification": t} for i, t in enumerate(at)] + [{"file_ls": "archive_status", "modification": at[0]}])
    rows = server.wal_hourly(c).collect()
    assert [r["day_id"] for r in rows] == ["20240102", "20240101"]
    assert all(r["wal_num_all"] == sum(r[f"wal_num_{h:02d}_{h + 1:02d}"] for h in range(24)) for r in rows)
    assert rows[1]["wal_num_23_24"] == 2


def test_high_null_saving(spark):
    big = 20 << 20
    c = small_catalog(
        spark, pg_attribute=[{"relid": 10, "attnum": n, "attname": f"c{n}"} for n in (1, 2, 3)],
        pg_stats=[{"relid": 10, "attname": "c1", "null_frac": 0.25}, {"relid": 10, "attname": "c2", "null_frac": 0.0}],
        pg_index=[{"indexrelid": n, "indrelid": 10, "indexname": f"i{n}", "indkey": str(n), "index_bytes": big, "indisprimary": False} for n in (1, 2, 3)]
        + [{"indexrelid": 4, "indrelid": 10, "indexname": "two", "indkey": "1 2", "index_bytes": big, "indisprimary": False}])
    assert values(indexes.high_null_indexes(c), "index", "null_frac", "expected_saving") == [
        ("i3", None, None), ("i1", "  25.00%", "5120 kB"), ("i2", "", "0 bytes")]


def test_build_progress_without_a_session(spark):
    c = small_catalog(spark, pg_stat_progress_create_index=[{"pid": 1, "relid": 2, "index_relid": 3, "lockers_done": 1, "lockers_total": 4}])
    assert values(indexes.index_build_progress(c), "pid_and_query", "index_name", "table_name", "lockers_progress", "blocks_progress") == [
        ("[] ", "3", "2", "25.00% (1 of 4)", "N/A (? of ?)")]

"""Catalog views as projections of the test tables.

The expressions are written in the SQL that Spark and DuckDB share, so one
definition gives both the input of a query and the input of its oracle. Rows
are selected only where the selection is what the view means (which relation is
partitioned, which role has a parent); no view is thinned out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import Catalog

NOW = "2024-02-01 00:00:00"

# Server settings of the test catalog.
SETTINGS = {
    "block_size": "8192",
    "autovacuum_freeze_max_age": "200000000",
    "autovacuum_vacuum_threshold": "50",
    "autovacuum_vacuum_scale_factor": "0.2",
}


@dataclass(frozen=True)
class Fixture:
    """``columns`` of ``source``, after an optional explode, filter and grouping."""

    source: str
    columns: dict[str, str]
    where: str | None = None
    each: tuple[str, Sequence[int | str]] | None = None
    group_by: tuple[str, ...] = ()

    def frame(self, source: DataFrame) -> DataFrame:
        df = source
        if self.each is not None:
            name, values = self.each
            df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        if self.where is not None:
            df = df.filter(self.where)
        columns = [F.expr(e).alias(n) for n, e in self.columns.items()]
        if self.group_by:
            # Group columns not asked for by name are dropped again.
            return df.groupBy(*self.group_by).agg(*columns).select(*self.columns)
        return df.select(*columns)

    def sql(self) -> str:
        source = self.source
        if self.each is not None:
            name, values = self.each
            source += f", (select unnest({list(values)!r}) as {name})"
        text = f"select {', '.join(f'{e} as {n}' for n, e in self.columns.items())} from {source}"
        if self.where is not None:
            text += f" where {self.where}"
        if self.group_by:
            text += f" group by {', '.join(self.group_by)}"
        return text


FIXTURES: dict[str, Fixture] = {
    "pg_namespace": Fixture("region", {
        "oid": "cast(r_regionkey+1 as bigint)",
        "nspname": "case r_regionkey when 0 then 'public' when 1 then 'pg_catalog'"
                   " when 2 then 'information_schema' when 3 then 'pg_toast' else 'app' end",
    }),
    "pg_type": Fixture("region", {
        "oid": "cast(r_regionkey as bigint)",
        "typname": "case r_regionkey when 0 then 'int8' when 1 then 'text' when 2 then 'jsonb' else 'bytea' end",
    }),
    "pg_class": Fixture("part", {
        "oid": "100000+p_partkey",
        "relname": "concat('t_',cast(p_partkey as string))",
        "relnamespace": "cast(1+p_size%5 as bigint)",
        "relkind": "case p_partkey%10 when 0 then 'p' when 1 then 'i' when 2 then 't'"
                   " when 3 then 'm' when 4 then 'v' else 'r' end",
        "relowner": "16385+p_partkey%50",
        "relfilenode": "100000+p_partkey+case when p_partkey%4=0 then 1 else 0 end",
        "reltuples": "cast(p_size*p_partkey as bigint)",
        "relpages": "cast(p_size*40 as bigint)",
        "reltoastrelid": "case when p_partkey%10>=8 then 100000+p_partkey-p_partkey%10+2 else 0 end",
        "relispartition": "(p_partkey%10=5)",
        "relfrozenxid": "3+(p_partkey*7919)%1000000",
        "relopts": "case when p_partkey%7=0 then"
                   " 'autovacuum_vacuum_threshold=500autovacuum_vacuum_scale_factor=0.05'"
                   " when p_partkey%7=1 then 'autovacuum_enabled=off' else null end",
        "relpartbound": "case when p_partkey%10=5 then concat('FOR VALUES IN (',cast(p_partkey as string),')') else null end",
        "relation_size": "cast(p_size*40*8192 as bigint)",
        "indexes_size": "(p_partkey%13)*81920",
        "table_size": "cast(p_size*40*8192+p_partkey%3*8192 as bigint)",
        "total_size": "cast(p_size*40*8192+p_partkey%3*8192 as bigint)+(p_partkey%13)*81920",
    }),
    "pg_inherits": Fixture("part", {
        "inhrelid": "100000+p_partkey",
        "inhparent": "100000+cast(floor(p_partkey/7.0) as bigint)",
    }, where="p_partkey>0"),
    "pg_partitioned_table": Fixture("part", {
        "partrelid": "100000+p_partkey",
        "partstrat": "case when p_partkey%30=0 then 'l' when p_partkey%30=10 then 'r' else 'h' end",
        "partexprs": "case when p_partkey%20=0 then 'lower(name)' else null end",
    }, where="p_partkey%10=0"),
    "pg_attribute": Fixture("part", {
        "relid": "100000+p_partkey",
        "attnum": "attnum",
        "attisdropped": "(attnum=5 and p_partkey%18=0)",
        "attname": "concat('c',cast(attnum as string))",
        "attstorage": "case attnum when 1 then 'p' when 2 then 'x' when 3 then 'e' when 4 then 'm' else 'z' end",
        "atttypid": "cast(attnum%3 as bigint)",
    }, where="attnum<=4 or p_partkey%9=0", each=("attnum", [-1, 1, 2, 3, 4, 5])),
    "pg_stats": Fixture("part", {
        "relid": "100000+p_partkey",
        "attname": "concat('c',cast(attnum as string))",
        "null_frac": "cast((p_partkey+attnum)%4 as double)/4.0e0",
        "avg_width": "cast(4+p_size%16+attnum as bigint)",
    }, each=("attnum", [1, 2, 3, 4])),
    "pg_stat_user_tables": Fixture("part", {
        "relid": "100000+p_partkey",
        "relname": "concat('t_',cast(p_partkey as string))",
        "n_live_tup": "cast(p_size*p_partkey as bigint)",
        "n_dead_tup": "(p_partkey*37)%5000",
        "n_tup_ins": "p_partkey*11",
        "n_tup_upd": "p_partkey*5",
        "n_tup_del": "p_partkey*2",
        "seq_scan": "p_partkey%17",
        "idx_scan": "case when p_partkey%19=0 then null else p_partkey*3 end",
        "autovacuum_count": "p_partkey%23",
        "last_vacuum": "case when p_partkey%3=0 then timestamp '2024-01-10 00:00:00' else null end",
        "last_autovacuum": "case when p_partkey%5=0 then timestamp '2024-01-20 00:00:00' else null end",
    }, where="p_partkey%10>=5"),
    "pg_index": Fixture("lineitem", {
        "indexrelid": "10000000+l_orderkey*8+l_linenumber",
        "indrelid": "100000+min(l_partkey)",
        "indexname": "concat('i_',cast(l_orderkey as string),'_',cast(l_linenumber as string))",
        "indkey": "case when min(l_suppkey)%3=0 then concat(cast(1+min(l_suppkey)%4 as string),' ',"
                  "cast(1+min(l_partkey)%4 as string)) when min(l_suppkey)%13=0 then '0' else cast(1+min(l_suppkey)%4 as string) end",
        "indnatts": "case when min(l_suppkey)%3=0 then 2 else 1 end",
        "indisunique": "(min(l_suppkey)%11=0)",
        "indisprimary": "(min(l_suppkey)%22=0)",
        "indclass": "case when min(l_suppkey)%5=0 then '1978' else '1979' end",
        "indexprs": "case when min(l_suppkey)%13=0 and min(l_suppkey)%3<>0 then concat('lower(c',cast(1+min(l_partkey)%2 as string),')') else null end",
        "indpred": "case when min(l_suppkey)%7=0 then 'x > 0' else null end",
        "amname": "case when min(l_suppkey)%9=0 then 'gin' else 'btree' end",
        "idx_scan": "cast((l_orderkey*l_linenumber)%50 as bigint)",
        "idx_tup_read": "cast((l_orderkey*l_linenumber)%5000 as bigint)",
        "idx_tup_fetch": "cast((l_orderkey*l_linenumber)%3000 as bigint)",
        "reltuples": "cast((l_orderkey*13)%100000 as bigint)",
        "relpages": "cast((l_orderkey*7)%20000 as bigint)",
        "index_bytes": "cast((l_orderkey*7)%20000 as bigint)*8192",
    }, group_by=("l_orderkey", "l_linenumber")),
    "pg_roles": Fixture("customer", {"oid": "16385+c_custkey", "rolname": "c_name"}),
    "pg_auth_members": Fixture("customer", {
        "member": "16385+c_custkey",
        "roleid": "16385+cast(floor(c_custkey/6.0) as bigint)",
    }, where="c_custkey>0"),
    "table_grants": Fixture("part", {
        "relid": "100000+p_partkey",
        "grantee": "16385+(p_partkey+length(perm))%200",
        "perm": "perm",
    }, each=("perm", ["SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER"])),
    "pg_database": Fixture("nation", {
        "oid": "cast(n_nationkey+1 as bigint)",
        "datname": "lower(n_name)",
        "datdba": "cast(16385+n_regionkey as bigint)",
        "datfrozenxid": "cast(3+n_nationkey*7919 as bigint)",
        "datallowconn": "(n_nationkey%6<>0)",
        "database_size": "cast(n_nationkey as bigint)*123456789",
    }),
    "pg_stat_database": Fixture("customer", {
        "datid": "cast(c_nationkey+1 as bigint)",
        "datname": "case when c_nationkey%12=0 then concat('template',cast(c_nationkey as string))"
                   " else concat('nation_',cast(c_nationkey as string)) end",
        "blks_hit": "case when c_nationkey%10=3 then 0 else cast(sum(c_custkey) as bigint) end",
        "blks_read": "case when c_nationkey%10=3 then 0 else cast(sum(c_custkey%(2+c_nationkey*90)) as bigint) end",
        "xact_commit": "cast(sum(c_custkey%97)+1 as bigint)",
        "xact_rollback": "cast(sum(c_custkey%5) as bigint)",
        "temp_bytes": "cast(sum(c_custkey*1000) as bigint)",
        "deadlocks": "cast(sum(c_custkey%2) as bigint)",
        "conflicts": "cast(sum(c_custkey%3) as bigint)",
        "temp_files": "cast(sum(c_custkey%11) as bigint)",
        "checksum_failures": "cast(c_nationkey%3 as bigint)",
        "blk_read_time": "cast(sum(c_custkey%101) as double)/8.0e0",
        "blk_write_time": "cast(sum(c_custkey%103) as double)/4.0e0",
        "session_time": "cast(sum(c_custkey%107) as double)/2.0e0",
        "active_time": "cast(sum(c_custkey%109) as double)/2.0e0",
        "idle_in_transaction_time": "cast(sum(c_custkey%113) as double)/2.0e0",
        "sessions": "cast(sum(c_custkey%17) as bigint)",
        "sessions_abandoned": "cast(sum(c_custkey%7) as bigint)",
        "sessions_fatal": "cast(sum(c_custkey%4) as bigint)",
        "sessions_killed": "cast(c_nationkey%4 as bigint)",
    }, group_by=("c_nationkey",)),
    "pg_stat_activity": Fixture("events", {
        "pid": "event_id",
        "datname": "case when user_id%11=0 then null else concat('db',cast(user_id%5 as string)) end",
        "usename": "concat('user_',cast(user_id%20 as string))",
        "application_name": "event_type",
        "state": "case event_type when 'view' then 'idle' when 'click' then 'active'"
                 " when 'purchase' then 'idle in transaction' when 'signup' then 'active' else null end",
        "wait_event": "case when event_id%3=0 then null else concat('we',cast(event_id%7 as string)) end",
        "wait_event_type": "case when event_id%3=0 then null else concat('wt',cast(event_id%4 as string)) end",
        "client_addr": "case when event_id%3=0 then null else concat('10.1.',cast(user_id%4 as string),'.',cast(event_id%250 as string),'/32') end",
        "client_port": "cast(event_id%60000 as int)",
        "state_change": "case when event_id%7=0 then null else ts end",
        "query_start": "ts",
        "xact_start": "case when event_id%5=0 then null else ts end",
        "backend_xid": "case when event_id%4=0 then 3+event_id*17 else null end",
        "backend_xmin": "case when event_id%6=0 then 3+event_id*13 else null end",
        "query": "case event_id%6 when 0 then 'VACUUM t' when 1 then"
                 " 'autovacuum: VACUUM t (to prevent wraparound)' when 2 then"
                 " 'select * from PG_STAT_ACTIVITY' else concat('select ',cast(event_id as string)) end",
    }),
    "fleet_activity": Fixture("events", {
        "cluster_id": "case when event_id%3=0 then 0 else user_id%8 end",
        "pid": "event_id",
        "datname": "case when user_id%11=0 then null else concat('db',cast(user_id%5 as string)) end",
        "state": "case event_type when 'view' then 'idle' when 'click' then 'active'"
                 " when 'purchase' then 'idle in transaction' when 'signup' then 'active' else null end",
        "wait_event": "case when event_id%3=0 then null else concat('we',cast(event_id%7 as string)) end",
        "wait_event_type": "case when event_id%3=0 then null else concat('wt',cast(event_id%4 as string)) end",
    }),
    "locks_chain": Fixture("customer", {
        "pid": "1+c_custkey",
        "relation": "case when held=1 then 1+c_custkey else cast(floor((1+c_custkey)/8.0) as bigint) end",
        "granted": "(held=1)",
        "locktype": "'relation'",
        "mode": "case when held=1 then 'AccessExclusiveLock' else 'RowExclusiveLock' end",
    }, where="held=1 or c_custkey>=7", each=("held", [1, 0])),
    # Groups of six sessions: rings, chains, and rings with a way into another ring.
    "locks_ring": Fixture("customer", {
        "pid": "1+c_custkey",
        "relation": "case held when 1 then 1+c_custkey when 0 then 1+c_custkey-c_custkey%6+(c_custkey+1)%6"
                    " else c_custkey-11 end",
        "granted": "(held=1)",
        "locktype": "'relation'",
        "mode": "case when held=1 then 'AccessExclusiveLock' else 'RowExclusiveLock' end",
    }, where="held=1 or (held=0 and not (cast(floor(c_custkey/6.0) as bigint)%3=1 and c_custkey%6=5))"
             " or (held=2 and cast(floor(c_custkey/6.0) as bigint)%3=2 and c_custkey%6=0)", each=("held", [1, 0, 2])),
    # Chains of a hundred roles.
    "role_chains": Fixture("customer", {
        "member": "16385+c_custkey",
        "roleid": "16385+c_custkey-1",
    }, where="c_custkey%100>0"),
    "locks_dense": Fixture("lineitem", {
        "pid": "l_orderkey",
        "locktype": "case when l_linenumber%2=0 then 'tuple' else 'relation' end",
        "database": "l_suppkey%5",
        "relation": "l_partkey",
        "page": "case when l_linenumber%2=0 then l_suppkey%3 else null end",
        "granted": "(l_linestatus='F')",
        "mode": "case l_linenumber when 1 then 'AccessShareLock' when 2 then 'RowShareLock'"
                " when 3 then 'RowExclusiveLock' when 4 then 'ShareLock'"
                " when 5 then 'ShareRowExclusiveLock' when 6 then 'ExclusiveLock'"
                " else 'AccessExclusiveLock' end",
    }),
    "pg_stat_replication": Fixture("supplier", {
        "client_addr": "concat('10.0.0.',cast(s_suppkey as string))",
        "usename": "s_name",
        "state": "case when s_suppkey%4=0 then 'catchup' else 'streaming' end",
        "sync_state": "case when s_suppkey%2=0 then 'sync' else 'async' end",
        "current_lsn": "'16/B374D848'",
        "sent_lsn": "concat('16/',hex(3000000000-s_suppkey*1024))",
        "write_lsn": "concat('16/',hex(3000000000-s_suppkey*3000))",
        "flush_lsn": "concat('16/',hex(3000000000-s_suppkey*5000))",
        "replay_lsn": "concat('15/',hex(4000000000-s_suppkey*7000))",
        "backend_xmin": "case when s_suppkey%3=0 then 3+s_suppkey*29 else null end",
        "application_name": "concat('standby_',cast(s_suppkey%7 as string))",
        "write_lag": "cast(s_suppkey%40 as double)/8.0e0",
        "flush_lag": "case when s_suppkey%5=0 then null else cast(s_suppkey%60 as double)/4.0e0 end",
        "replay_lag": "cast(s_suppkey%90 as double)/2.0e0",
    }),
    "pg_prepared_xacts": Fixture("orders", {
        "transaction": "3+o_orderkey*11",
        "gid": "concat('gid_',cast(o_orderkey as string))",
        "prepared": "o_orderdate",
        "owner": "concat('user_',cast(o_custkey%20 as string))",
        "database": "concat('db',cast(o_custkey%5 as string))",
    }),
    "pg_replication_slots": Fixture("supplier", {
        "slot_name": "s_name",
        "xmin": "case when s_suppkey%4=0 then 3+s_suppkey*31 else null end",
    }),
    "pg_stat_progress_vacuum": Fixture("orders", {
        "pid": "o_orderkey",
        "datname": "concat('db',cast(o_custkey%5 as string))",
        "relid": "100000+o_custkey",
        "phase": "case o_orderstatus when 'F' then 'vacuuming heap' when 'O' then 'scanning heap'"
                 " else 'vacuuming indexes' end",
        "heap_blks_total": "o_custkey%50",
        "heap_blks_scanned": "o_custkey%50-(o_custkey%50)%3",
        "heap_blks_vacuumed": "(o_custkey%50)-(o_custkey%50)%7",
        "index_vacuum_count": "o_custkey%4",
        "num_dead_tuples": "o_custkey%1000",
        "max_dead_tuples": "cast(1000 as bigint)",
    }),
    "pg_stat_progress_create_index": Fixture("orders", {
        "pid": "o_orderkey",
        "relid": "100000+o_custkey",
        "index_relid": "10000000+o_orderkey*8+1",
        "phase": "case o_orderstatus when 'F' then 'building index' else 'initializing' end",
        "current_locker_pid": "o_orderkey+5",
        "lockers_done": "case when o_custkey%7=0 then null else o_custkey%3 end",
        "lockers_total": "o_custkey%4",
        "blocks_done": "o_custkey%100",
        "blocks_total": "o_custkey%100+o_custkey%9",
        "tuples_done": "o_custkey",
        "tuples_total": "o_custkey*3",
        "partitions_done": "cast(0 as bigint)",
        "partitions_total": "cast(0 as bigint)",
    }),
    "wal_files": Fixture("events", {
        "file_ls": "case when event_id%1000=0 then 'archive_status' else"
                   " concat('0000000100000000',lpad(hex(event_id),8,'0')) end",
        "size": "cast(16777216 as bigint)",
        "modification": "ts",
    }),
    "pg_stat_bgwriter": Fixture("nation", {
        "cluster_id": "cast(n_nationkey as bigint)",
        "checkpoints_timed": "cast(n_nationkey*3 as bigint)",
        "checkpoints_req": "cast(n_nationkey%4 as bigint)",
        "buffers_clean": "cast(n_nationkey*1000 as bigint)",
        "buffers_checkpoint": "cast(n_nationkey*77777 as bigint)",
        "buffers_backend": "cast(n_nationkey*555 as bigint)",
        "buffers_backend_fsync": "cast(0 as bigint)",
    }),
    "pg_stat_archiver": Fixture("nation", {
        "cluster_id": "cast(n_nationkey as bigint)",
        "archived_count": "cast(n_nationkey*1000 as bigint)",
        "last_archived_wal": "concat('00000001000000000000',lpad(hex(n_nationkey*5),4,'0'))",
        "last_failed_wal": "case when n_nationkey%3=0 then null else"
                           " concat('00000001000000000000',lpad(hex(n_nationkey*n_nationkey),4,'0')) end",
        "last_archived_time": "case when n_nationkey%2=0 then timestamp '2024-01-15 00:00:00' else timestamp '2024-01-16 01:02:03' end",
        "failed_count": "cast(n_nationkey%3 as bigint)",
        "last_failed_time": "case when n_nationkey%3=0 then null else timestamp '2024-01-14 12:00:00' end",
        "stats_reset": "timestamp '2024-01-01 00:00:00'",
    }),
    "pg_stat_wal": Fixture("nation", {
        "cluster_id": "cast(n_nationkey as bigint)",
        "wal_records": "cast(n_nationkey*1009 as bigint)",
        "wal_fpi": "cast(n_nationkey*13 as bigint)",
        "wal_bytes": "cast(n_nationkey*65536 as bigint)",
        "wal_buffers_full": "cast(n_nationkey*7 as bigint)",
        "wal_write": "cast(n_nationkey*11 as bigint)",
        "wal_sync": "cast(n_nationkey%5 as bigint)",
        "wal_write_time": "cast(n_nationkey as double)/4.0e0",
        "wal_sync_time": "cast(n_nationkey as double)/8.0e0",
        "stats_reset": "case when n_nationkey%2=0 then timestamp '2024-01-01 00:00:00' else timestamp '2024-01-09 10:11:12' end",
    }),
    "pg_depend": Fixture("lineitem", {
        "view_oid": "100000+(l_orderkey%200)*10+4",
        "refobjid": "100000+l_partkey",
        "refobjsubid": "l_linenumber%5",
    }),
    "pg_constraint": Fixture("lineitem", {
        "conname": "concat('con_',cast(l_partkey as string),'_',cast(l_suppkey as string))",
        "conrelid": "100000+l_partkey",
        "column_name": "case when min(l_linenumber)=7 then null else"
                       " concat('c',cast(1+l_suppkey%4 as string)) end",
        "cons_def": "concat('CHECK (c',cast(1+l_suppkey%4 as string),' > 0)')",
    }, group_by=("l_partkey", "l_suppkey")),
    # Settings and server values that differ by cluster.
    "cluster_settings": Fixture("nation", {
        "cluster_id": "cast(n_nationkey as bigint)",
        "name": "name",
        "setting": "case when name='block_size' then '8192' when n_nationkey%5=0 then 'off' else 'on' end",
    }, each=("name", ["block_size", "archive_mode"])),
    "cluster_info": Fixture("nation", {
        "cluster_id": "cast(n_nationkey as bigint)",
        "postmaster_start": "timestamp '2024-01-01 00:00:00'",
    }),
    # A fleet in which one cluster has a third of everything.
    "fleet_class": Fixture("part", {
        "cluster_id": "case when p_partkey%3=0 then 0 else p_partkey%8 end",
        "oid": "100000+p_partkey",
        "relname": "concat('t_',cast(p_partkey as string))",
        "relnamespace": "cast(1+p_size%5 as bigint)",
        "relkind": "case p_partkey%4 when 0 then 't' when 1 then 'v' else 'r' end",
        "relfrozenxid": "3+(p_partkey*7919)%1000000",
        "total_size": "cast(p_size*40*8192 as bigint)",
    }),
    "fleet_namespace": Fixture("region", {
        "cluster_id": "cast(cluster_id as bigint)",
        "oid": "cast(r_regionkey+1 as bigint)",
        "nspname": "case r_regionkey when 0 then 'public' when 3 then 'pg_toast' else 'app' end",
    }, each=("cluster_id", [0, 1, 2, 3, 4, 5, 6, 7])),
    "fleet_info": Fixture("nation", {
        "cluster_id": "cast(n_nationkey as bigint)",
        "next_xid": "cast(2000000+n_nationkey*1000 as bigint)",
    }),
    "standby_info": Fixture("supplier", {
        "cluster_id": "s_suppkey",
        "in_recovery": "true",
        "receive_lsn": "concat('16/',hex(3000000000-s_suppkey*3000))",
        "replay_lsn": "case when s_suppkey%5=0 then concat('16/',hex(3000000000-s_suppkey*3000))"
                      " else concat('15/',hex(4000000000-s_suppkey*7000)) end",
        "last_replay_time": "timestamp '2024-01-31 23:59:00'",
    }),
}

#: View -> fixture, where the names differ.
ALIASES = {"pg_locks": "locks_dense"}


def load(spark: SparkSession, sf_dir: str, fixture: str) -> DataFrame:
    f = FIXTURES[fixture]
    return f.frame(spark.read.parquet(f"{sf_dir}/{f.source}.parquet"))


class _Views(Mapping[str, DataFrame]):
    """Fixtures by view name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, aliases: dict[str, str]) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.names = {n: n for n in FIXTURES if n.startswith(("pg_", "table_", "wal_"))} | aliases
        self.frames: dict[str, DataFrame] = {}

    def __getitem__(self, view: str) -> DataFrame:
        if view not in self.frames:
            self.frames[view] = self._make(view)
        return self.frames[view]

    def _make(self, view: str) -> DataFrame:
        if view in self.names:
            return load(self.spark, self.sf_dir, self.names[view])
        if view == "settings":
            rows = ", ".join(f"('{k}', '{v}')" for k, v in SETTINGS.items())
            return self.spark.sql(f"select * from values {rows} as t(name, setting)")
        if view == "server_info":
            # The snapshot's horizon is the smallest id any session still sees.
            return self["pg_stat_activity"].agg(
                F.lit(2000000).cast("bigint").alias("next_xid"),
                F.min("backend_xmin").alias("snapshot_xmin"),
                F.lit("db0").alias("current_database"),
            )
        raise KeyError(view)

    def __iter__(self) -> Iterator[str]:
        yield from {*self.names, "settings", "server_info"}

    def __len__(self) -> int:
        return len({*self.names, "settings", "server_info"})


def catalog(
    spark: SparkSession, sf_dir: str, keys: Sequence[str] = (), **aliases: str
) -> Catalog:
    """The test catalog; ``aliases`` replaces views, as in ``pg_locks="locks_chain"``."""
    now = F.lit(NOW).cast("timestamp")
    return Catalog(_Views(spark, sf_dir, {**ALIASES, **aliases}), keys=keys, now=now)


def with_fixtures(*names: str) -> str:
    """``with a as (…), b as (…)`` for an oracle."""
    return "with recursive " + ", ".join(f"{n} as ({FIXTURES[n].sql()})" for n in names)

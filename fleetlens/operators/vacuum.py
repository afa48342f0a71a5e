"""Vacuum progress, need and queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import percent
from fleetlens.functions.order import down, up
from fleetlens.functions.text import human_bytes, quote_identifier
from fleetlens.functions.times import seconds_between
from fleetlens.sources.catalog import Catalog

WRAPAROUND = "^autovacuum.*to prevent wraparound"
BY_USER = "^vacuum"


def _mode(query: Column, any_case: bool) -> Column:
    flags = "(?is)" if any_case else "(?s)"
    return (
        F.when(query.rlike(flags + WRAPAROUND), "wraparound")
        .when(query.rlike(flags + BY_USER), "user")
        .otherwise("regular")
    )


def _waiting() -> Column:
    """``type.event``, or ``f`` when either part is missing."""
    return F.coalesce(F.concat("wait_event_type", F.lit("."), "wait_event"), F.lit("f"))


def vacuum_progress(c: Catalog) -> DataFrame:
    """Vacuums under way with mode, phase and progress, longest first."""
    sessions = c.table("pg_stat_activity").select(
        *c.on("pid", "xact_start", "query", "wait_event", "wait_event_type")
    )
    df = (
        c.table("pg_stat_progress_vacuum")
        .join(sessions, c.on("pid"), "inner")
        .join(
            c.pick("pg_class", relid="oid", table_found="relname", total_bytes="total_size"),
            c.on("relid"),
            "left",
        )
    )

    def blocks(column: str) -> Column:
        return human_bytes(F.col(column) * F.col("block_size"))

    df = c.with_setting(df, "block_size", "bigint").select(
        *c.on("pid"),
        seconds_between(F.col("xact_start"), c.now).alias("duration"),
        _waiting().alias("waiting"),
        _mode(F.col("query"), any_case=True).alias("mode"),
        F.col("datname").alias("database"),
        F.coalesce("table_found", F.col("relid").cast("string")).alias("table"),
        "phase",
        blocks("heap_blks_total").alias("table_size"),
        human_bytes(F.col("total_bytes")).alias("total_size"),
        blocks("heap_blks_scanned").alias("scanned"),
        blocks("heap_blks_vacuumed").alias("vacuumed"),
        percent(F.col("heap_blks_scanned"), F.col("heap_blks_total"), 1).alias("scanned_pct"),
        percent(F.col("heap_blks_vacuumed"), F.col("heap_blks_total"), 1).alias("vacuumed_pct"),
        "index_vacuum_count",
        percent(F.col("num_dead_tuples"), F.col("max_dead_tuples"), 1).alias("dead_pct"),
    )
    return c.sort(df, down("duration"), up("pid"))


def vacuum_needed(
    c: Catalog, base_threshold: float = 50, scale_factor: float = 0.1
) -> DataFrame:
    """Tables with their dead rows against a threshold, those over it first."""
    threshold = base_threshold + scale_factor * F.col("reltuples")
    df = (
        c.table("pg_stat_user_tables")
        .join(c.pick("pg_class", relid="oid", reltuples="reltuples"), c.on("relid"), "inner")
        .select(
            *c.on("relname", "n_dead_tup"),
            threshold.alias("vacuum_threshold"),
            "n_live_tup", "n_tup_del", "n_tup_upd", "autovacuum_count", "last_vacuum", "last_autovacuum",
            c.now.alias("now"),
            "reltuples",
            (F.col("n_dead_tup") > threshold).alias("is_vacuum"),
        )
    )
    return c.sort(df, down("is_vacuum"), up("relname"))


IN_QUEUE = "~~~ in queue ~~~"


def _vacuum_settings(c: Catalog) -> DataFrame:
    """Threshold and scale factor of every relation: its own options or the server's.

    The options are one string without separators; a number ends where the next
    option's name begins.
    """
    df = c.table("pg_class").select(
        *c.on("relname", "relnamespace", "reltuples", "relopts"), F.col("oid").alias("relid")
    )
    for name in ("autovacuum_vacuum_threshold", "autovacuum_vacuum_scale_factor"):
        df = c.with_setting(df, name, "string").withColumn(
            name,
            F.when(
                F.col("relopts").contains(name),
                F.regexp_extract("relopts", f".*{name}=([0-9.]+)", 1),
            ).otherwise(F.col(name)),
        )
    disabled = F.col("relopts").rlike("autovacuum_enabled=(false|off)")
    return df.select(
        *c.on("relid", "relname", "reltuples"),
        F.col("relnamespace").alias("nsp_oid"),
        F.col("autovacuum_vacuum_threshold").alias("threshold"),
        F.col("autovacuum_vacuum_scale_factor").alias("scale_factor"),
        F.coalesce(~disabled, F.lit(True)).alias("enabled"),
    )


def vacuum_queue(c: Catalog) -> DataFrame:
    """Tables being vacuumed or due for it by their own settings.

    A vacuum of another database has no table here; it stays, named after that
    database.
    """
    index_counts = (
        c.table("pg_index")
        .groupBy(*[F.col(k) for k in c.keys], F.col("indrelid").alias("relid"))
        .agg(F.count(F.lit(1)).alias("n_indexes"))
    )
    tables = (
        c.table("pg_stat_user_tables")
        .select(*c.on("relid", "n_dead_tup", "last_vacuum", "last_autovacuum"))
        .join(_vacuum_settings(c), c.on("relid"), "inner")
        .join(index_counts, c.on("relid"), "left")
    )
    running = c.with_server_info(
        c.table("pg_stat_progress_vacuum").drop("num_dead_tuples", "max_dead_tuples"),
        "current_database",
    )
    same = (tables["relid"] == running["relid"]) & (running["datname"] == running["current_database"])
    for key in c.keys:
        same = same & (tables[key] == running[key])
    df = tables.join(running, same, "full").select(
        *[F.coalesce(tables[k], running[k]).alias(k) for k in c.keys],
        tables["relid"].alias("table_id"),
        running["relid"].alias("running_id"),
        *[x for x in tables.columns if x not in {*c.keys, "relid"}],
        *[x for x in running.columns if x not in {*c.keys, "relid"}],
    )
    due = (
        F.col("threshold").cast("bigint") + F.col("scale_factor").cast("double") * F.col("reltuples")
        < F.col("n_dead_tup")
    )
    sessions = c.table("pg_stat_activity").select(
        *c.on("query", "wait_event", "wait_event_type"),
        F.col("pid").alias("session_key"),
        F.col("pid").alias("session"),
    )
    # All joins above share one partitioning, by relation. Only what is in the
    # queue goes on to the lookups; rows without a schema or a session spread.
    df = (
        df.filter(F.col("table_id").isNull() | F.col("phase").isNotNull() | due)
        .withColumns(
            {
                "nsp_oid": F.coalesce("nsp_oid", -F.col("pid")),
                "session_key": F.coalesce("pid", -F.col("table_id")),
            }
        )
        .join(c.pick("pg_namespace", nsp_oid="oid", nspname="nspname"), c.on("nsp_oid"), "left")
        .join(sessions, c.on("session_key"), "left")
    )
    shown_schema = F.coalesce(F.concat(F.nullif("nspname", F.lit("public")), F.lit(".")), F.lit(""))
    elsewhere = F.concat(F.lit('[something in "'), quote_identifier(F.col("datname")), F.lit('"]'))
    second = "yyyy-MM-dd HH:mm:ss"
    by_auto = F.col("last_vacuum").isNull() | (F.col("last_autovacuum") > F.col("last_vacuum"))
    last_vacuumed = F.when(
        F.col("last_autovacuum").isNotNull() & by_auto,
        F.concat(F.date_format("last_autovacuum", second), F.lit(" (auto)")),
    ).when(
        F.col("last_vacuum").isNotNull(),
        F.concat(F.date_format("last_vacuum", second), F.lit(" (manual)")),
    )
    df = df.select(
        *c.keys,
        F.coalesce(F.concat(shown_schema, "relname"), elsewhere).alias("relation"),
        percent(F.col("n_dead_tup"), F.col("reltuples"), 2).alias("dead_tup_pct"),
        "reltuples",
        "n_dead_tup",
        F.format_string(
            "vt: %s, vsf: %s, %s",
            F.coalesce("threshold", F.lit("")),
            F.coalesce("scale_factor", F.lit("")),
            F.when(~F.col("enabled"), "DISABLED").otherwise("enabled"),
        ).alias("effective_settings"),
        last_vacuumed.alias("last_vacuumed"),
        F.coalesce("phase", F.lit(IN_QUEUE)).alias("status"),
        "pid",
        F.when(F.col("session").isNotNull(), _mode(F.col("query"), any_case=False)).alias("mode"),
        F.when(F.col("session").isNotNull(), _waiting()).alias("waiting"),
        percent(F.col("heap_blks_scanned"), F.col("heap_blks_total"), 1).alias("scanned_pct"),
        percent(F.col("heap_blks_vacuumed"), F.col("heap_blks_total"), 1).alias("vacuumed_pct"),
        "index_vacuum_count",
        F.when(
            F.col("table_id").isNotNull() & F.col("running_id").isNotNull(),
            F.coalesce("n_indexes", F.lit(0)),
        ).alias("index_count"),
    )
    return c.sort(df, up("status"), up("relation"))

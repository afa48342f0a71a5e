"""Index structure, use and build progress. Bloat is in :mod:`bloat`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.numbers import percent, ratio, to_whole
from fleetlens.functions.order import down, up
from fleetlens.functions.text import human_bytes, progress_text
from fleetlens.functions.times import seconds_between
from fleetlens.plans.containment import contained_in
from fleetlens.plans.levels import keep_rows
from fleetlens.plans.skew import HOT_ROWS, grid_join
from fleetlens.sources.catalog import TOAST_SCHEMA, Catalog

MEGABYTE = 1 << 20


def _tables(c: Catalog) -> DataFrame:
    return c.pick("pg_class", indrelid="oid", table="relname", nsp_oid="relnamespace")


def index_columns(c: Catalog, table: str | None = None) -> DataFrame:
    """Column names of every index of an ordinary table, in key order.

    The rows collected per index are its key columns, a handful by nature.
    """
    tables = c.table("pg_class").filter(F.col("relkind") == "r")
    if table is not None:
        tables = tables.filter(F.col("relname") == table)
    tables = tables.select(
        *c.keys,
        F.col("oid").alias("indrelid"),
        F.col("relname").alias("table_name"),
        F.col("relnamespace").alias("nsp_oid"),
    )
    names = (
        c.table("pg_index")
        .select(
            *c.on("indexrelid", "indrelid"),
            F.col("indexname").alias("index_name"),
            F.posexplode(F.split("indkey", " ")).alias("pos", "key"),
        )
        .withColumn("attnum", F.col("key").cast("int"))
        .join(
            c.large(c.pick("pg_attribute", indrelid="relid", attnum="attnum", attname="attname")),
            c.on("indrelid", "attnum"),
            "inner",
        )
        .groupBy(*c.on("indexrelid", "indrelid", "index_name"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "attname"))).alias("parts"))
    )
    # A column named twice in one key counts once, at its first position.
    first_seen = F.array_distinct(F.transform("parts", lambda p: p["attname"]))
    df = (
        names.join(c.large(tables), c.on("indrelid"), "inner")
        .join(c.pick("pg_namespace", nsp_oid="oid", table_schema="nspname"), c.on("nsp_oid"), "left")
        .select(
            *c.on("table_schema", "table_name", "index_name"),
            F.array_join(first_seen, ", ").alias("column_names"),
        )
    )
    return c.sort(df, up("table_name"), up("index_name"))


def duplicate_indexes(c: Catalog) -> DataFrame:
    """Groups of indexes on the same table with the same definition, largest first.

    Only the first four names of a group are ever moved: the rank filter keeps
    four per group and task before the shuffle, and count and size are partial
    sums. A group with a large share of all indexes therefore stays cheap.
    """
    group = c.on("indrelid", "indclass_key", "indkey", "indexprs_key", "indpred_key")
    indexes = c.table("pg_index").select(
        *c.on("indrelid", "indkey", "indexname", "index_bytes"),
        *[F.coalesce(x, F.lit("")).alias(f"{x}_key") for x in ("indclass", "indexprs", "indpred")],
    )
    totals = (
        indexes.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("index_bytes").alias("total_bytes"))
        .filter(F.col("n") > 1)
    )
    first = (
        indexes.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*group).orderBy("indexname"))
        )
        .filter(F.col("rank") <= 4)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list("indexname")).alias("names"))
    )
    df = (
        totals.join(first, group, "inner")
        .join(_tables(c), c.on("indrelid"), "left")
        .join(c.schemas(), c.on("nsp_oid"), "left")
        .select(
            *c.keys,
            F.concat("nspname", F.lit("."), "table").alias("table"),
            "n",
            "total_bytes",
            human_bytes(F.col("total_bytes")).alias("size"),
            *[F.get("names", F.lit(i)).alias(f"idx{i + 1}") for i in range(4)],
        )
    )
    return c.sort(df, down("total_bytes"), up("table"), up("idx1"))


def contained_indexes(c: Catalog, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Btree indexes whose key columns are all in the key of another index of the table.

    The other index has to cover the whole table, so it has no predicate. Of two indexes over the same
    columns the younger one is listed. Keys that hold an expression cannot be compared
    by position and are left out.

    Containment is found between classes, the distinct column sets of a user table; the last join makes
    the pairs of indexes, which are not shuffled. ``hot_rows`` is that of :func:`grid_join`.
    """
    keys = (
        c.table("pg_index")
        .filter((F.lower("amname") == "btree") & F.col("indrelid").isNotNull() & F.col("indexrelid").isNotNull())
        .select(
            *c.on("indrelid", "indexrelid", "indexname", "index_bytes", "indisunique"),
            F.col("indpred").isNull().alias("whole"), F.split("indkey", " ").cast("array<int>").alias("items"),
        )
        .filter(~F.array_contains("items", 0))
        .withColumn("columns", F.sort_array(F.array_distinct("items")))
    )
    named = _tables(c).join(c.user_schemas(TOAST_SCHEMA), c.on("nsp_oid"), "inner").select(
        *c.on("indrelid"), F.col("nspname").alias("schema"), "table"
    )
    classes = keep_rows(
        keys.groupBy(*c.on("indrelid", "columns"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("n_whole"))
        .join(named, c.on("indrelid"), "left_semi")
    )
    of = lambda side, rows: rows.select(
        *c.on("indrelid"), F.col("columns").alias(f"{side}_id"), F.col("columns").alias(f"{side}_items")
    )
    pairs = contained_in(of("left", classes), of("right", classes.filter("n_whole > 0")), c.on("indrelid"), hot_rows)
    pairs = pairs.join(named, c.on("indrelid"), "inner").select(
        *c.on("indrelid", "schema", "table"), F.col("left_id").alias("left_columns"), F.col("right_id").alias("right_columns")
    )
    left = keys.select(
        *c.on("indrelid"), F.col("columns").alias("left_columns"), F.col("indexrelid").alias("left_id"),
        F.col("indexname").alias("index"), "indisunique", "index_bytes",
    )
    right = keys.filter("whole").select(
        *c.on("indrelid"), F.col("columns").alias("right_columns"), F.col("indexrelid").alias("right_id"),
        F.col("indexname").alias("contained_in"),
    )
    # No key of a table has more rows on the left than the table has indexes.
    most = classes.groupBy(*c.on("indrelid")).agg(F.sum("n").alias("m")).filter(F.col("m") > hot_rows)
    counts = classes.join(most, c.on("indrelid")).select(
        *c.on("indrelid"), F.col("columns").alias("right_columns"), "m", F.col("n_whole").alias("n")
    )
    sizes = F.size("left_columns"), F.size("right_columns")
    df = (
        grid_join(
            pairs.join(left, c.on("indrelid", "left_columns"), "inner"), right, c.on("indrelid", "right_columns"),
            "left_id", "right_id", hot_rows, counts=counts,
        )
        .filter((F.col("left_id") != F.col("right_id")) & ((sizes[0] < sizes[1]) | (F.col("left_id") > F.col("right_id"))))
        .select(
            *c.on("schema", "table", "index", "indisunique", "index_bytes", "contained_in"),
            (sizes[0] == sizes[1]).alias("same_columns"),
        )
    )
    return c.sort(df, down("index_bytes"), up("index"), up("contained_in"))


def index_usage(c: Catalog) -> DataFrame:
    """Indexes of user schemas by number of scans, least used first."""
    df = (
        c.table("pg_index")
        .join(_tables(c), c.on("indrelid"), "inner")
        .join(c.user_schemas(TOAST_SCHEMA), c.on("nsp_oid"), "inner")
        .select(
            *c.keys,
            F.col("nspname").alias("schema"),
            "table",
            F.col("indexname").alias("index"),
            "indisunique",
            F.col("idx_scan").alias("idx_scans"),
        )
    )
    return c.sort(df, up("idx_scans"), up("index"))


def index_state(
    c: Catalog, schema: str | None = None, keep_unindexed: bool = False
) -> DataFrame:
    """Size, shape and use of every index of the user tables.

    ``keep_unindexed`` also lists the tables of ``schema`` that have no index,
    with NULL index columns.
    """
    kinds = ["r", "p"] if keep_unindexed else ["r", "t", "i"]
    schemas = c.user_schemas(TOAST_SCHEMA)
    if schema is not None:
        schemas = c.schemas().filter(F.col("nspname") == schema)
    tables = (
        c.table("pg_class")
        .filter(F.col("relkind").isin(*kinds))
        .select(
            *c.keys,
            F.col("oid").alias("indrelid"),
            "relname",
            F.col("relnamespace").alias("nsp_oid"),
            F.col("reltuples").alias("num_rows"),
            F.col("relpages").alias("num_pages"),
            "relation_size",
            "total_size",
        )
        .join(schemas, c.on("nsp_oid"), "inner")
    )
    indexes = c.table("pg_index").select(
        *c.on("indrelid", "indexname", "index_bytes", "indisunique", "idx_scan", "idx_tup_read", "idx_tup_fetch")
    )
    df = tables.join(indexes, c.on("indrelid"), "left" if keep_unindexed else "inner").select(
        *c.keys,
        F.concat("nspname", F.lit("."), "relname").alias("table"),
        F.col("indexname").alias("index_name"),
        human_bytes(F.col("relation_size")).alias("table_size"),
        human_bytes(F.col("index_bytes")).alias("index_size"),
        human_bytes(F.col("total_size")).alias("total_size"),
        "num_rows",
        "num_pages",
        ratio(F.col("num_rows"), F.col("num_pages")).alias("num_per_page"),
        F.when(F.col("indisunique"), "Y").otherwise("N").alias("unique"),
        F.col("idx_scan").alias("number_of_scans"),
        F.col("idx_tup_read").alias("tuples_read"),
        F.col("idx_tup_fetch").alias("tuples_fetched"),
    )
    return c.sort(df, up("table"), up("index_name"))


def index_summary(c: Catalog, schema: str | None = None, faithful: bool = False) -> DataFrame:
    """Number of indexes per user table: all, unique, single- and multi-column.

    A table without an index has zeros. ``faithful=True`` counts its one empty
    outer-join row as an index with several columns, as a plain ``count(*)``
    over that join would.
    """
    per_table = (
        c.table("pg_index")
        .groupBy(*c.on("indrelid"))
        .agg(
            F.count(F.lit(1)).alias("total_indexes"),
            F.count_if("indisunique").alias("unique_indexes"),
            F.count_if(F.col("indnatts") == 1).alias("single_column_indexes"),
            F.count_if(~F.col("indnatts").eqNullSafe(F.lit(1))).alias("multi_column_indexes"),
        )
    )
    schemas = c.user_schemas(TOAST_SCHEMA)
    if schema is not None:
        schemas = schemas.filter(F.col("nspname") == schema)
    empty = F.lit(1 if faithful else 0)
    df = (
        c.table("pg_class")
        .filter(F.col("relkind") == "r")
        .select(
            *c.keys, F.col("oid").alias("indrelid"), "relname", "reltuples",
            F.col("relnamespace").alias("nsp_oid"),
        )
        .join(schemas, c.on("nsp_oid"), "inner")
        .join(per_table, c.on("indrelid"), "left")
        .select(
            *c.keys,
            F.col("nspname").alias("schema"),
            F.col("relname").alias("table"),
            F.col("reltuples").alias("num_rows"),
            F.coalesce("total_indexes", empty).alias("total_indexes"),
            F.coalesce("unique_indexes", F.lit(0)).alias("unique_indexes"),
            F.coalesce("single_column_indexes", F.lit(0)).alias("single_column_indexes"),
            F.coalesce("multi_column_indexes", empty).alias("multi_column_indexes"),
        )
    )
    return c.sort(df, up("schema"), down("table"))


LARGE_INDEX_BYTES = 100_000_000


def unused_indexes(c: Catalog) -> DataFrame:
    """Non-unique indexes that cost more than they give, with the reason.

    The reasons exclude each other, so each index is judged in one pass.
    """
    activity = c.table("pg_stat_user_tables").select(
        *c.keys,
        F.col("relid").alias("indrelid"),
        (F.col("idx_scan") + F.col("seq_scan")).alias("all_scans"),
        (F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del")).alias("writes"),
    )
    total_writes = activity.groupBy(*c.keys).agg(F.sum("writes").alias("total_writes"))
    tables = c.pick(
        "pg_class", indrelid="oid", tablename="relname", nsp_oid="relnamespace", table_bytes="relation_size"
    )
    scans = F.col("idx_scan")
    df = (
        c.table("pg_index")
        .filter(~F.col("indisunique"))
        .select(
            *c.on("indrelid", "indexname", "idx_scan", "index_bytes"),
            (F.lower("amname") == "btree").alias("is_btree"),
        )
        .join(activity, c.on("indrelid"), "inner")
        .withColumns(
            {
                "index_scan_pct": F.when(F.col("all_scans") == 0, F.lit(0.0)).otherwise(
                    percent(scans, F.col("all_scans"), 2)
                ),
                "scans_per_write": F.when(
                    F.col("writes") == 0, scans.cast("double")
                ).otherwise(F.round(ratio(scans, F.col("writes")), 2)),
            }
        )
    )
    df = c.attach(df, total_writes, ["total_writes"])
    btree, large = F.col("is_btree"), F.col("index_bytes") > LARGE_INDEX_BYTES
    rare = F.col("scans_per_write") <= 1
    write_share = F.col("writes") / (F.col("total_writes") + 1)
    reasons = [
        ("Never Used Indexes", btree & (scans == 0)),
        ("Low Scans, High Writes",
         btree & (scans > 0) & rare & (F.col("index_scan_pct") < 10) & (F.col("writes") > 100)),
        ("Seldom Used Large Indexes",
         btree & (scans > 0) & (F.col("scans_per_write") > 1) & (F.col("index_scan_pct") < 5) & large),
        ("High-Write Large Non-Btree", ~btree & large & (write_share > 0.02)),
    ]
    group: Column = F.lit(None).cast("int")
    reason: Column = F.lit(None).cast("string")
    for number, (label, holds) in reversed(list(enumerate(reasons, 1))):
        group = F.when(holds, number).otherwise(group)
        reason = F.when(holds, label).otherwise(reason)
    df = (
        df.withColumns({"grp": group, "reason": reason})
        .filter(F.col("grp").isNotNull())
        .join(tables, c.on("indrelid"), "inner")
        .join(c.schemas(), c.on("nsp_oid"), "inner")
        .select(
            *c.on("grp", "reason"),
            F.col("nspname").alias("schemaname"),
            "tablename", "indexname", "index_scan_pct", "scans_per_write",
            human_bytes(F.col("index_bytes")).alias("index_size"),
            human_bytes(F.col("table_bytes")).alias("table_size"),
            "index_bytes",
        )
    )
    return c.sort(df, up("grp"), down("index_bytes"), up("indexname")).drop("grp", "index_bytes")


def high_null_indexes(c: Catalog, min_bytes: int = 10 * MEGABYTE) -> DataFrame:
    """Large plain single-column indexes with the null share of their column.

    The column of an index on an expression is its own first one, with statistics
    under the index; without them its null share is NULL.
    ``expected_saving`` is what an index on the non-null rows only would save.
    """
    stats = c.pick("pg_stats", col_relid="relid", attname="attname", frac="null_frac")
    saving = F.col("index_bytes") * F.col("frac")
    df = (
        c.table("pg_index")
        .filter(
            ~F.col("indisprimary")
            & F.col("indpred").isNull()
            & (F.size(F.split("indkey", " ")) == 1)
            & (F.col("index_bytes") > min_bytes)
        )
        .withColumn("expression", F.col("indkey") == "0")
        .withColumn("attnum", F.when(F.col("expression"), 1).otherwise(F.col("indkey").cast("int")))
        .withColumn("col_relid", F.when(F.col("expression"), F.col("indexrelid")).otherwise(F.col("indrelid")))
        .join(
            c.large(c.pick("pg_attribute", col_relid="relid", attnum="attnum", attname="attname")),
            c.on("col_relid", "attnum"),
            "left",
        )
        .filter("expression or attname is not null")
        .join(c.large(stats), c.on("col_relid", "attname"), "left")
        .select(
            *c.keys,
            F.col("indexrelid").alias("oid"),
            F.col("indexname").alias("index"),
            human_bytes(F.col("index_bytes")).alias("index_size"),
            F.col("indisunique").alias("unique"),
            F.col("attname").alias("indexed_column"),
            F.when(F.col("frac") == 0, "")
            .when(F.col("frac").isNotNull(), F.format_string("%7.2f%%", F.col("frac") * 100))
            .alias("null_frac"),
            human_bytes(to_whole(saving)).alias("expected_saving"),
            saving.alias("saving_bytes"),
        )
    )
    return c.sort(df, down("saving_bytes"), up("oid")).drop("saving_bytes")


QUERY_HEAD = 150


def index_build_progress(c: Catalog) -> DataFrame:
    """Index builds under way: duration, wait, the session in the way, progress."""
    lockers = c.table("pg_stat_activity").select(
        *c.keys,
        F.col("pid").alias("current_locker_pid"),
        F.concat(
            F.nullif(F.left("query", F.lit(QUERY_HEAD)), F.lit("")), F.lit("...")
        ).alias("current_locker_query"),
    )
    builders = c.table("pg_stat_activity").select(
        *c.on("pid"), F.col("pid").alias("builder"), "query", "query_start", "wait_event", "wait_event_type"
    )
    df = (
        c.table("pg_stat_progress_create_index")
        .join(builders, c.on("pid"), "left")
        .join(lockers, c.on("current_locker_pid"), "left")
        .join(c.pick("pg_index", index_relid="indexrelid", index_found="indexname"), c.on("index_relid"), "left")
        .join(
            c.pick("pg_class", relid="oid", table_found="relname", table_bytes="relation_size"),
            c.on("relid"),
            "left",
        )
        .select(
            *c.keys,
            c.now.alias("now"),
            F.col("query_start").alias("started_at"),
            seconds_between(F.col("query_start"), c.now).alias("query_duration"),
            F.concat(
                F.lit("["), F.coalesce(F.col("builder").cast("string"), F.lit("")), F.lit("] "),
                F.coalesce("query", F.lit("")),
            ).alias("pid_and_query"),
            F.coalesce("index_found", F.col("index_relid").cast("string")).alias("index_name"),
            F.coalesce("table_found", F.col("relid").cast("string")).alias("table_name"),
            human_bytes(F.col("table_bytes")).alias("table_size"),
            "phase",
            F.concat(F.nullif("wait_event_type", F.lit("")), F.lit(": "), "wait_event").alias(
                "wait_type_and_event"
            ),
            "current_locker_pid",
            "current_locker_query",
            *[
                progress_text(F.col(f"{what}_done"), F.col(f"{what}_total")).alias(f"{what}_progress")
                for what in ("lockers", "blocks", "tuples", "partitions")
            ],
        )
    )
    return c.sort(df, up("index_name"))

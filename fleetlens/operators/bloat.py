"""Estimates of wasted space in tables and indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import align_pad, ratio, spread_absent, to_whole
from fleetlens.functions.order import down, up
from fleetlens.sources.catalog import TOAST_SCHEMA, Catalog

# Fixed values of the page layout the estimates assume.
MAX_ALIGN = 8
TUPLE_HEADER = 23
LINE_POINTER = 4
TABLE_PAGE_HEADER = 20
TOAST_TUPLES_PER_PAGE = 4
INDEX_PAGE_HEADER = 24
INDEX_TUPLE_HEADER = 2
INDEX_TUPLE_HEADER_WITH_NULLS = 6
INDEX_ITEM_POINTER = 6
UNKNOWN_WIDTH = 1024
MEGABYTE = 1 << 20

#: (least percent, least MB): a table is reported when one rule holds.
BLOAT_RULES = ((50.0, 10.0), (25.0, 1000.0))


def _table_stats(c: Catalog) -> DataFrame:
    """One row per relation of a user schema: its size and its statistics.

    Columns and statistics meet once, in a full outer join, and are reduced to
    one row per relation. What is missing on either side shows in the counts, so
    no later stage has to look at columns again.
    """
    columns = c.columns().select(*c.on("relid", "attname", "attnum"))
    null_frac, width = F.col("null_frac"), F.col("avg_width")
    bitmap_bytes = F.call_function("div", F.count_if(null_frac != 0), F.lit(8))
    per_relation = (
        columns.join(c.table("pg_stats").withColumn("has_stats", F.lit(True)), c.on("relid", "attname"), "full")
        .groupBy(*c.on("relid"))
        .agg(
            F.count("attnum").alias("n_columns"),
            F.count("has_stats").alias("n_stats"),
            F.count_if(F.col("has_stats").isNull()).alias("n_gaps"),
            F.sum((1 - null_frac) * width).alias("data_width"),
            F.max("null_frac").alias("max_null_frac"),
            (F.lit(TUPLE_HEADER + 1) + bitmap_bytes).alias("null_header"),
        )
    )
    relations = c.table("pg_class").select(
        *c.keys,
        F.col("oid").alias("relid"),
        F.col("relname").alias("tablename"),
        F.col("relnamespace").alias("nsp_oid"),
        "relkind", "reltuples", "relpages", "table_size",
        spread_absent(F.col("reltoastrelid"), F.col("oid")).alias("toast_key"),
    )
    counted = c.pick("pg_stat_user_tables", relid="relid", n_live_tup="n_live_tup").withColumn(
        "is_counted", F.lit(True)
    )
    return (
        per_relation.join(relations, c.on("relid"), "inner")
        .join(counted, c.on("relid"), "left")
        .join(c.user_schemas(), c.on("nsp_oid"), "inner")
        # Only tables the server counts rows of are called incomplete.
        .withColumn("incomplete", (F.col("n_gaps") > 0) & F.col("is_counted").isNotNull())
    )


def tables_without_stats(c: Catalog) -> DataFrame:
    """User tables with at least one column that has no statistics."""
    return _table_stats(c).filter("incomplete").select(
        *c.on("relid", "nspname", "tablename"),
        F.col("n_live_tup").alias("est_rows"),
        F.col("table_size").alias("table_bytes"),
    )


def _row_width() -> Column:
    fixed_part = TUPLE_HEADER + MAX_ALIGN - (TUPLE_HEADER % MAX_ALIGN or MAX_ALIGN)
    return F.col("data_width") + fixed_part


def _null_width() -> Column:
    return F.col("max_null_frac") * align_pad(F.col("null_header"), MAX_ALIGN)


def _has_shape() -> Column:
    return (F.col("n_stats") > 0) & (F.col("n_columns") > 0) & ~F.col("incomplete")


def row_shapes(c: Catalog) -> DataFrame:
    """Per relation with complete statistics: average row width and null header."""
    return _table_stats(c).filter(_has_shape()).select(
        *c.on("relid"), _row_width().alias("row_width"), _null_width().alias("null_width")
    )


def bloat_estimates(c: Catalog) -> DataFrame:
    """Actual against expected size of every user table.

    Tables with incomplete statistics are listed too, with ``can_estimate``
    false and no estimate.
    """
    toast = (
        c.table("pg_class")
        .filter(F.col("relkind") == "t")
        .select(
            *c.keys,
            F.col("oid").alias("toast_key"),
            F.col("relpages").alias("toast_pages"),
            F.col("reltuples").alias("toast_tuples"),
        )
    )
    tables = _table_stats(c).filter(
        F.col("incomplete") | (_has_shape() & (F.col("relkind") == "r"))
    ).join(toast, c.on("toast_key"), "left")
    tables = c.with_server_info(c.with_setting(tables, "block_size", "bigint"), "current_database")

    block = F.col("block_size")
    tuple_bytes = align_pad(_row_width(), MAX_ALIGN) + _null_width() + LINE_POINTER
    pages = F.ceil(F.col("reltuples") * tuple_bytes / (block - TABLE_PAGE_HEADER))
    toast_pages = F.ceil(F.coalesce("toast_tuples", F.lit(0)) / TOAST_TUPLES_PER_PAGE)
    held = (F.col("relpages") + F.coalesce("toast_pages", F.lit(0))) * block
    known = ~F.col("incomplete")
    tables = tables.select(
        *c.on("current_database", "nspname", "tablename"),
        known.alias("can_estimate"),
        F.when(known, F.col("reltuples")).otherwise(F.col("n_live_tup")).alias("est_rows"),
        F.when(known, held).otherwise(F.col("table_size")).cast("double").alias("held"),
        F.when(known, (pages + toast_pages) * block).cast("double").alias("expected"),
    )
    table, expected = F.col("table_bytes"), F.col("expected_bytes")
    waste = F.when((expected > 0) & (table > 0) & (expected <= table), table - expected)
    return (
        tables.withColumns(
            {
                # A table of unknown shape keeps even a size of zero.
                "table_bytes": F.when((F.col("held") > 0) | ~F.col("can_estimate"), F.col("held")),
                "expected_bytes": F.when(F.col("expected") > 0, F.col("expected")),
            }
        )
        .withColumn("bloat_bytes", F.when(F.col("can_estimate"), F.coalesce(waste, F.lit(0.0))))
        .select(
            *c.keys,
            F.col("current_database").alias("databasename"),
            F.col("nspname").alias("schemaname"),
            "tablename",
            "can_estimate",
            "est_rows",
            F.round(ratio(F.col("bloat_bytes") * 100, table), 0).alias("pct_bloat"),
            F.round(F.col("bloat_bytes") / MEGABYTE, 2).alias("mb_bloat"),
            F.round(table / MEGABYTE, 3).alias("table_mb"),
            F.round(expected / MEGABYTE, 3).alias("expected_mb"),
            "table_bytes",
            "expected_bytes",
            "bloat_bytes",
        )
    )


def relation_bloat(
    c: Catalog, rules: Sequence[tuple[float, float]] = BLOAT_RULES
) -> DataFrame:
    """Tables whose estimated waste passes one of the rules, worst first."""
    passes = F.lit(False)
    for least_percent, least_mb in rules:
        passes = passes | (
            (F.col("pct_bloat") >= least_percent) & (F.col("mb_bloat") >= least_mb)
        )
    df = (
        bloat_estimates(c)
        .filter(passes)
        .select(
            *c.on("databasename", "schemaname", "tablename"),
            "can_estimate", "est_rows", "pct_bloat", "mb_bloat", "table_mb",
        )
    )
    return c.sort(df, down("pct_bloat"), up("schemaname"), up("tablename"))


def _column_stats(c: Catalog) -> DataFrame:
    """Statistics by column position: (keys, relid, attnum, null_frac, avg_width)."""
    return c.pick("pg_attribute", relid="relid", attnum="attnum", attname="attname").join(
        c.large(c.table("pg_stats")), c.on("relid", "attname"), "inner"
    ).select(*c.on("relid", "attnum"), "null_frac", "avg_width")


def index_key_widths(c: Catalog) -> DataFrame:
    """Per btree index with pages: tuple header and average width of its key.

    A key column that is an expression (position 0) keeps its statistics under
    the index itself, any other one under the table, so a single equi join on
    (relation, position) finds both. The other columns of the index are carried
    along, which spares a second look at the index table.
    """
    carried = c.on("indexrelid", "indrelid", "indexname", "reltuples", "relpages", "idx_scan")
    keys = (
        c.table("pg_index")
        .filter((F.lower("amname") == "btree") & (F.col("relpages") > 0))
        .select(*carried, F.posexplode(F.split("indkey", " ")).alias("pos", "key"))
        .withColumn("key", F.col("key").cast("int"))
        .select(
            *carried,
            F.when(F.col("key") == 0, F.col("indexrelid")).otherwise(F.col("indrelid")).alias("relid"),
            F.when(F.col("key") == 0, F.col("pos") + 1).otherwise(F.col("key")).alias("attnum"),
        )
    )
    null_frac = F.coalesce("null_frac", F.lit(0.0))
    width = F.coalesce("avg_width", F.lit(UNKNOWN_WIDTH))
    return (
        keys.join(c.large(_column_stats(c)), c.on("relid", "attnum"), "inner")
        .groupBy(*carried)
        .agg(
            F.when(F.max(null_frac) == 0, INDEX_TUPLE_HEADER)
            .otherwise(INDEX_TUPLE_HEADER_WITH_NULLS)
            .alias("tuple_header"),
            F.sum((1 - null_frac) * width).alias("key_width"),
        )
    )


def index_bloat(c: Catalog) -> DataFrame:
    """Estimated waste in btree indexes, most wasteful first."""
    tables = c.pick(
        "pg_class", indrelid="oid", relname="relname", nsp_oid="relnamespace", table_bytes="relation_size"
    )
    df = (
        index_key_widths(c)
        .withColumnsRenamed({"indexname": "idxname", "idx_scan": "idx_scans"})
        .join(c.large(tables), c.on("indrelid"), "inner")
        .join(c.user_schemas(TOAST_SCHEMA), c.on("nsp_oid"), "inner")
    )
    df = c.with_server_info(c.with_setting(df, "block_size", "bigint"), "current_database")

    # The header is lifted to the next boundary; the key by its rounded width.
    key = F.col("key_width")
    overhang = to_whole(key) % MAX_ALIGN
    key_bytes = key + MAX_ALIGN - F.when(overhang == 0, MAX_ALIGN).otherwise(overhang)
    header = F.col("tuple_header")
    header_fill = MAX_ALIGN - F.when(header % MAX_ALIGN == 0, MAX_ALIGN).otherwise(header % MAX_ALIGN)
    tuple_bytes = INDEX_ITEM_POINTER + header_fill + key_bytes
    usable = (F.col("block_size") - INDEX_PAGE_HEADER).cast("double")
    expected = F.coalesce(F.ceil(F.col("reltuples") * tuple_bytes / usable + 1), F.lit(0))

    df = df.withColumn("expected", expected.cast("double"))
    extra = F.when(
        F.col("relpages") > F.col("expected"), to_whole(F.col("relpages") - F.col("expected"))
    ).otherwise(0)
    total_bytes = F.col("block_size") * F.col("relpages")
    df = df.withColumns(
        {
            "bloat_pct": F.round(ratio(F.col("block_size") * extra * 100, total_bytes), 0),
            "bloat_mb": F.round(F.col("block_size") * extra / MEGABYTE, 0),
            "total_mb": F.round(total_bytes / MEGABYTE, 3),
            "table_mb": F.round(F.col("table_bytes") / MEGABYTE, 3),
        }
    ).select(
        *c.keys,
        F.col("current_database").alias("datname"),
        "nspname",
        "relname",
        "idxname",
        "idx_scans",
        "bloat_pct",
        "table_mb",
        F.round(F.col("total_mb") - F.col("bloat_mb"), 3).alias("actual_mb"),
        "bloat_mb",
        "total_mb",
    )
    return c.sort(df, down("bloat_mb"), up("nspname"), up("idxname"))

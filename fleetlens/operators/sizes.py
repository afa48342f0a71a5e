"""Sizes and structure of tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import int_div, spread_absent
from fleetlens.functions.order import down, up
from fleetlens.functions.text import human_bytes, row_text
from fleetlens.sources.catalog import TOAST_SCHEMA, Catalog


def relation_sizes(c: Catalog, schema: str | None = None) -> DataFrame:
    """Sizes of the ordinary tables of a schema (all schemas if None), largest first."""
    schemas = c.pick("pg_namespace", relnamespace="oid", table_schema="nspname")
    if schema is not None:
        schemas = schemas.filter(F.col("table_schema") == schema)
    toast = (
        c.table("pg_class")
        .filter(F.col("relkind") == "t")
        .select(*c.keys, F.col("oid").alias("toast_key"), F.col("total_size").alias("toast_bytes"))
    )
    df = (
        c.table("pg_class")
        .filter(F.col("relkind") == "r")
        .withColumn("toast_key", spread_absent(F.col("reltoastrelid"), F.col("oid")))
        .join(schemas, c.on("relnamespace"), "left" if schema is None else "inner")
        .join(toast, c.on("toast_key"), "left")
        .select(
            *c.keys,
            "oid",
            "relfilenode",
            F.when(F.col("oid") == F.col("relfilenode"), "NO")
            .otherwise("YES")
            .alias("has_been_rewrite"),
            "table_schema",
            F.col("relname").alias("table_name"),
            F.col("reltuples").alias("row_estimate"),
            F.col("total_size").alias("total_bytes"),
            F.col("indexes_size").alias("index_bytes"),
            "toast_bytes",
        )
        .withColumn(
            "table_bytes",
            F.col("total_bytes") - F.col("index_bytes") - F.coalesce("toast_bytes", F.lit(0)),
        )
        .withColumns(
            {
                "table": human_bytes(F.col("table_bytes")),
                "index": human_bytes(F.col("index_bytes")),
                "total": human_bytes(F.col("total_bytes")),
            }
        )
    )
    return c.sort(df, down("total_bytes"), up("oid"))


def relation_constraints(c: Catalog, table: str | None = None) -> DataFrame:
    """Constraints on user tables with the column they use and their definition."""
    tables = c.pick("pg_class", conrelid="oid", table_name="relname", nsp_oid="relnamespace")
    if table is not None:
        tables = tables.filter(F.col("table_name") == table)
    df = (
        c.table("pg_constraint")
        .filter(F.col("column_name").isNotNull())
        .join(tables, c.on("conrelid"), "inner")
        .join(c.user_schemas(TOAST_SCHEMA), c.on("nsp_oid"), "inner")
        .select(
            *c.keys,
            F.col("conname").alias("constraint_name"),
            F.col("nspname").alias("table_schema"),
            "table_name",
            "column_name",
            "cons_def",
        )
    )
    return c.sort(df, up("constraint_name"), up("table_schema"), up("table_name"))


def _with_toast(c: Catalog, tables: DataFrame) -> DataFrame:
    toast = (
        c.table("pg_class")
        .filter(F.col("relkind") == "t")
        .select(
            *c.keys,
            F.col("oid").alias("reltoastrelid"),
            F.col("relname").alias("found_name"),
            F.col("relation_size").alias("toast_size"),
        )
    )
    df = (
        tables.filter(F.col("reltoastrelid") != 0)
        .join(c.pick("pg_namespace", relnamespace="oid", schema="nspname"), c.on("relnamespace"))
        .join(toast, c.on("reltoastrelid"), "left")
        .select(
            *c.keys,
            "schema",
            "relname",
            F.coalesce("found_name", F.col("reltoastrelid").cast("string")).alias("toast_name"),
            "toast_size",
        )
    )
    return c.sort(df, down("toast_name"), up("relname"))


def toast_tables(c: Catalog, schema: str | None = None) -> DataFrame:
    """Ordinary tables that have a toast table, with its name and size."""
    df = _with_toast(c, c.table("pg_class").filter(F.col("relkind") == "r"))
    return df if schema is None else df.filter(F.col("schema") == schema)


def toast_of_relation(c: Catalog, table: str | None = None) -> DataFrame:
    """The toast table of every relation called ``table``, in any schema."""
    relations = c.table("pg_class")
    if table is not None:
        relations = relations.filter(F.col("relname") == table)
    return _with_toast(c, relations)


# Storage codes of a column and their names.
STORAGE_NAMES = {"p": "plain", "x": "extended", "e": "external", "m": "main"}


def column_storage(c: Catalog, table: str | None = None, schema: str | None = None) -> DataFrame:
    """Columns of a table with type and storage strategy, by position.

    The schema tells tables of one name apart.
    """
    name = F.lit(None).cast("string")
    for code, label in STORAGE_NAMES.items():
        name = F.when(F.col("attstorage") == code, label).otherwise(name)
    relations = c.pick("pg_class", relid="oid", table_name="relname", nsp_oid="relnamespace")
    relations = relations.join(c.schemas(), c.on("nsp_oid"), "inner")
    if table is not None:
        relations = relations.filter(F.col("table_name") == table)
    if schema is not None:
        relations = relations.filter(F.col("nspname") == schema)
    df = (
        c.columns()
        .join(c.pick("pg_type", atttypid="oid", typname="typname"), c.on("atttypid"), "inner")
        .join(relations, c.on("relid"), "inner")
        .select(
            *c.keys, F.col("nspname").alias("schema_name"), "table_name", "attnum", "attname", "typname",
            name.alias("attstorage"),
        )
    )
    return c.sort(df, up("schema_name"), up("table_name"), up("attnum"))


SEPARATOR = "-" * 30


def table_profile(
    df: DataFrame,
    sizes: Mapping[str, int | Column],
    live: int | Column | None = None,
    dead: int | Column | None = None,
) -> DataFrame:
    """Row count, text size and size measures of any DataFrame.

    ``sizes`` maps a label to a number of bytes: a constant, or an aggregate
    over ``df``. The length of all rows as text follows as one more measure;
    ``live`` and ``dead`` are tuple counts. One aggregate feeds every row of the
    result.
    """

    def measure(value: int | Column | None) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")

    labels = [*sizes, "Live Row Byte Size"]
    totals = df.withColumn("row_length", F.length(row_text(df))).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[measure(v).alias(f"size_{i}") for i, v in enumerate(sizes.values())],
        F.sum("row_length").alias(f"size_{len(sizes)}"),
        measure(live).alias("live"),
        measure(dead).alias("dead"),
    )

    def line(label: str, bytes_: Column, pretty: Column, per_row: Column) -> Column:
        return F.struct(
            F.lit(label).alias("description"),
            bytes_.cast("bigint").alias("bytes"),
            pretty.cast("string").alias("bytes_pretty"),
            per_row.cast("bigint").alias("bytes_per_row"),
        )

    none = F.lit(None)
    lines = [
        line(
            label,
            F.col(f"size_{i}"),
            human_bytes(F.col(f"size_{i}")),
            int_div(F.col(f"size_{i}"), F.col("n_rows")),
        )
        for i, label in enumerate(labels)
    ]
    lines += [
        line(SEPARATOR, none, none, none),
        line("TotalRows", F.col("n_rows"), none, none),
        line("LiveTuples", F.col("live"), none, none),
        line("DeadTuples", F.col("dead"), none, none),
    ]
    return totals.select(F.inline(F.array(*lines)))

"""Partition and inheritance trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.order import down, up
from fleetlens.functions.text import human_bytes
from fleetlens.plans.graphs import tree_totals
from fleetlens.plans.levels import cut_lineage, union_all, walk_levels
from fleetlens.sources.catalog import TOAST_SCHEMA, Catalog

# Partition strategy codes and their names.
STRATEGY_NAMES = {"l": "BY LIST", "r": "BY RANGE", "h": "BY HASH"}
NOT_PARTITIONED = "not partitioned"


def partition_tree(c: Catalog, depth: int | None = None) -> DataFrame:
    """Every table below a root partitioned table, with strategy and bounds.

    The walk moves ids only; names and sizes are joined once, after it. A table
    reached from two roots appears twice. With ``depth``, the levels below the roots to
    go to, the walk is one recursive query instead of a job per level.
    """
    seed = (
        c.table("pg_class")
        .filter((F.col("relkind") == "p") & ~F.col("relispartition"))
        .select(
            *c.on("oid"),
            # No relation has a negative id: roots find no parent, and spread.
            (-F.col("oid")).alias("parent"),
            F.lit(0).alias("level"),
            F.array("oid").alias("visited"),
        )
    )
    edges = cut_lineage(c.pick("pg_inherits", oid="inhparent", child="inhrelid"))

    def step(level: DataFrame, _: int) -> DataFrame:
        return (
            level.join(edges, c.on("oid"), "inner")
            .filter(~F.array_contains("visited", F.col("child")))
            .select(
                *c.keys,
                F.col("child").alias("oid"),
                F.col("oid").alias("parent"),
                (F.col("level") + 1).alias("level"),
                F.array_append("visited", F.col("child")).alias("visited"),
            )
        )

    walked = union_all(walk_levels(seed, step)) if depth is None else _walk_at_once(c, seed, edges, depth)
    strategy = F.lit(NOT_PARTITIONED)
    for code, label in STRATEGY_NAMES.items():
        strategy = F.when(F.col("partstrat") == code, label).otherwise(strategy)
    tables = c.pick(
        "pg_class", oid="oid", table_name="relname", nsp_oid="relnamespace", reltuples="reltuples",
        relpages="relpages", partitioning_values="relpartbound",
    ).join(c.pick("pg_namespace", nsp_oid="oid", schema_name="nspname"), c.on("nsp_oid"), "inner")
    df = (
        walked.join(tables, c.on("oid"), "inner")
        .join(c.pick("pg_class", parent="oid", table_parent_name="relname"), c.on("parent"), "left")
        .join(
            c.pick("pg_partitioned_table", oid="partrelid", partstrat="partstrat", sub_partitioning_values="partexprs"),
            c.on("oid"),
            "left",
        )
        .select(
            *c.on("table_name", "schema_name", "reltuples", "relpages"),
            strategy.alias("partitioning_type"),
            "table_parent_name", "partitioning_values", "sub_partitioning_values", "level",
        )
    )
    return c.sort(df, up("table_name"), up("schema_name"), up("table_parent_name"))


def _walk_at_once(c: Catalog, seed: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The walk of :func:`partition_tree` as a recursive query of at most ``depth`` levels.

    Spark ends a recursion of more rows than ``spark.sql.cteRecursionRowLimit``; a walk that is too large
    for it is refused with the setting's name, and the level loop does it without a limit.
    """
    spark = seed.sparkSession
    same = "".join(f" and w.{k} <=> e.{k}" for k in c.keys)
    names = "".join(f"{k}, " for k in c.keys)
    kept = "".join(f"w.{k}, " for k in c.keys)
    query = f"""
        with recursive walk({names}oid, parent, level, visited) max recursion level {depth + 1} as (
            select {names}oid, parent, level, visited from {{seed}}
            union all
            select {kept}e.child, w.oid, w.level + 1, array_append(w.visited, e.child)
            from walk w join {{edges}} e on w.oid = e.oid{same}
            where w.level < {depth} and not array_contains(w.visited, e.child)
        )
        select {names}oid, parent, level from walk
    """
    try:
        return cut_lineage(spark.sql(query, seed=cut_lineage(seed), edges=edges))
    except Exception as e:
        if "RECURSION_ROW_LIMIT_EXCEEDED" not in str(e):
            raise
        limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
        raise ValueError(
            f"the walk has more than {limit} rows (spark.sql.cteRecursionRowLimit): leave depth out, or raise the setting"
        ) from e


def inherit_children(c: Catalog) -> DataFrame:
    """Direct parents and their ordinary-table children."""
    parents = c.pick("pg_class", inhparent="oid", parent="relname", parent_nsp="relnamespace").join(
        c.pick("pg_namespace", parent_nsp="oid", parent_schema="nspname"), c.on("parent_nsp"), "inner"
    )
    children = (
        c.pick("pg_class", inhrelid="oid", child="relname", child_nsp="relnamespace", relkind="relkind")
        .filter(F.col("relkind") == "r")
        .join(c.pick("pg_namespace", child_nsp="oid", child_schema="nspname"), c.on("child_nsp"), "inner")
    )
    df = (
        c.table("pg_inherits")
        .join(children, c.on("inhrelid"), "inner")
        .join(parents, c.on("inhparent"), "inner")
        .select(*c.on("parent_schema", "parent", "child_schema", "child"))
    )
    return c.sort(df, up("child"), up("child_schema"), up("parent"))


def partition_sizes(c: Catalog, database: str | None = None) -> DataFrame:
    """Sizes summed over the children of each parent, largest first.

    ``database`` keeps the children whose owner owns that database.
    """
    children = (
        c.table("pg_class")
        .filter(F.col("relkind").isin("r", "t", "m"))
        .withColumnsRenamed({"oid": "inhrelid", "relnamespace": "nsp_oid"})
        .join(c.user_schemas(TOAST_SCHEMA), c.on("nsp_oid"), "inner")
    )
    if database is not None:
        owners = c.pick("pg_database", relowner="datdba", datname="datname").filter(
            F.col("datname") == database
        )
        children = children.join(owners, c.on("relowner"), "left_semi")
    sums = (
        c.table("pg_inherits")
        .join(
            children.select(*c.on("inhrelid", "total_size", "relation_size", "table_size", "indexes_size")),
            c.on("inhrelid"),
            "inner",
        )
        .groupBy(*c.on("inhparent"))
        .agg(
            F.sum("total_size").alias("total_bytes"),
            F.sum("relation_size").alias("internal_bytes"),
            F.sum(F.col("table_size") - F.col("relation_size")).alias("external_bytes"),
            F.sum("indexes_size").alias("indexes_bytes"),
        )
    )
    df = sums.join(c.pick("pg_class", inhparent="oid", found="relname"), c.on("inhparent"), "left").select(
        *c.keys,
        F.coalesce("found", F.col("inhparent").cast("string")).alias("parent_table_name"),
        *[
            human_bytes(F.col(f"{part}_bytes")).alias(part)
            for part in ("total", "internal", "external", "indexes")
        ],
        "total_bytes",
    )
    return c.sort(df, down("total_bytes"), up("parent_table_name")).drop("total_bytes")


def partition_totals(c: Catalog) -> DataFrame:
    """Every table of an inheritance tree with its root, its depth and the totals of all below it.

    Sums cover the table and its whole subtree, found by pointer jumping: rounds grow with
    the logarithm of the depth. A table with several parents hangs below the
    one of the smallest id; ``n_parents`` tells. Tables the catalog does not know count
    as tables of size 0 and are named by their id. Tables on a cycle have no root and no totals.
    """
    links = c.table("pg_inherits").filter("inhrelid is not null and inhparent is not null and inhrelid <> inhparent")
    parents = links.groupBy(*c.keys, F.col("inhrelid").alias("node")).agg(
        F.min("inhparent").alias("parent"), F.count_distinct("inhparent").alias("n_parents")
    )
    nodes = union_all([links.select(*c.keys, F.col(x).alias("node")) for x in ("inhrelid", "inhparent")]).distinct()
    sizes = c.pick("pg_class", node="oid", total_bytes="total_size", est_rows="reltuples")
    totals = tree_totals(
        nodes.join(parents, c.on("node"), "left").join(sizes, c.on("node"), "left").select(
            *c.on("node", "parent"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
            F.coalesce("est_rows", F.lit(0)).cast("double").alias("est_rows"),
        ),
        c.keys,
    )
    named = totals.join(parents.drop("parent"), c.on("node"), "left")
    for column in ("node", "parent", "root"):
        named = named.join(c.pick("pg_class", **{column: "oid", f"{column}_name": "relname"}), c.on(column), "left").withColumn(
            f"{column}_name", F.coalesce(f"{column}_name", F.col(column).cast("string"))
        )
    df = named.select(
        *c.keys, F.col("node_name").alias("table_name"), F.col("parent_name").alias("table_parent_name"),
        F.col("root_name").alias("root_table_name"), "depth", F.coalesce("n_parents", F.lit(0)).alias("n_parents"),
        F.col("n_nodes").alias("n_tables"), "est_rows", "total_bytes", human_bytes(F.col("total_bytes")).alias("total"),
    )
    return c.sort(df, down("total_bytes"), up("table_name"))

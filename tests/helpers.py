"""Small catalogs by hand."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import NOW, SETTINGS
from fleetlens import Catalog
from fleetlens.sources.schemas import VIEWS

BASE = {
    "settings": [{"name": k, "setting": v} for k, v in SETTINGS.items()],
    "server_info": [{"next_xid": 2000000, "snapshot_xmin": 3, "current_database": "db0"}],
    "pg_namespace": [{"oid": 1, "nspname": "public"}, {"oid": 2, "nspname": "app"}, {"oid": 3, "nspname": "pg_toast"}],
}


def frame(spark: SparkSession, view: str, rows: list[dict]) -> DataFrame:
    """Rows in a view's schema, missing fields NULL; extra ``cluster_id`` allowed."""
    schema = T.StructType.fromDDL(VIEWS[view])
    if rows and "cluster_id" in rows[0]:
        schema = T.StructType([T.StructField("cluster_id", T.LongType()), *schema.fields])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


class _Rows(Mapping[str, DataFrame]):
    """Views made of rows when asked for."""

    def __init__(self, spark: SparkSession, rows: dict[str, list[dict]], keyed: bool) -> None:
        self.spark, self.rows, self.keyed = spark, rows, keyed

    def __getitem__(self, view: str) -> DataFrame:
        rows = self.rows[view]
        if self.keyed:
            rows = [{"cluster_id": r.get("cluster_id", 1), **r} for r in rows]
        df = frame(self.spark, view, rows)
        return df.withColumn("cluster_id", F.lit(1)) if self.keyed and not rows else df

    def __iter__(self) -> Iterator[str]:
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)


def small_catalog(spark: SparkSession, keys: tuple[str, ...] = (), **tables: list[dict]) -> Catalog:
    """A catalog of the given rows; unnamed views are empty, or :data:`BASE`."""
    rows = {**{v: [] for v in VIEWS}, **BASE, **tables}
    return Catalog(_Rows(spark, rows, bool(keys)), keys=keys, now=F.lit(NOW).cast("timestamp"), ordered=True)


def values(df: DataFrame, *columns: str) -> list:
    """Rows as tuples, or plain values for one column."""
    rows = df.select(*columns).collect()
    return [r[0] for r in rows] if len(columns) == 1 else [tuple(r) for r in rows]


def lock(pid: int, relation: int | None, granted: bool, mode: str = "ExclusiveLock", **more) -> dict:
    return {"pid": pid, "relation": relation, "granted": granted, "mode": mode, "locktype": "relation", **more}


def sessions(*pids: int, **more) -> list[dict]:
    return [{"pid": p, "state": "active", "usename": f"u{p}", "query": f"q{p}", **more} for p in pids]


def waits_for(edges: list[tuple[int, int]]) -> list[dict]:
    """Locks such that each (waiter, holder) pair, and no other, waits."""
    rows = []
    for target, (waiter, holder) in enumerate(edges, 1):
        rows += [lock(waiter, target, False), lock(holder, target, True)]
    return rows

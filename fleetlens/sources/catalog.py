"""The catalog: named views that share a key."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.sources.schemas import KEYS, PARTITION, VIEWS, view_columns

#: Schemas that belong to the server itself.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
TOAST_SCHEMA = "pg_toast"


class Catalog:
    """Views of one or many servers, one row set per key.

    ``keys`` names the columns that tell servers and snapshots apart. Every
    join, group, window and top-k of a report starts with them, so what is a
    constant or a single row on one server is an ordinary equi join here.
    ``now`` is the instant of the snapshot, never the wall clock. With
    Reports sort their rows only with ``ordered=True``: a written table has no order.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        keys: Sequence[str] = tuple(KEYS),
        now: Column | str = "snapshot_ts",
        ordered: bool = False,
    ) -> None:
        unknown = set(tables) - set(VIEWS)
        if unknown:
            raise ValueError(f"unknown views: {sorted(unknown)}")
        self._tables = tables
        self._conformed: dict[str, DataFrame] = {}
        self.keys = list(keys)
        self.now = F.col(now) if isinstance(now, str) else now
        self.ordered = ordered

    @classmethod
    def from_path(
        cls,
        spark: SparkSession,
        root: str,
        since: str | None = None,
        until: str | None = None,
        ordered: bool = False,
    ) -> Catalog:
        """Landed Parquet snapshots ``root/<view>/snapshot_date=…/``.

        ``since`` and ``until`` (both inclusive) prune partitions.
        """
        return cls(_Landed(spark, root, since, until), ordered=ordered)

    def has(self, name: str) -> bool:
        return name in self._tables

    def table(self, name: str) -> DataFrame:
        """A view in its superset schema: missing columns are NULL."""
        if name not in self._tables:
            raise KeyError(f"the snapshot has no view {name!r}")
        if name not in self._conformed:
            df = self._tables[name]
            present = set(df.columns)
            self._conformed[name] = df.selectExpr(
                *self.keys,
                *[
                    f"cast({column if column in present else 'null'} as {type}) as {column}"
                    for column, type in view_columns(name).items()
                ],
            )
        return self._conformed[name]

    def pick(self, name: str, **columns: str) -> DataFrame:
        """Keys plus ``new_name="source column"``, ready to join by name."""
        return self.table(name).selectExpr(
            *self.keys, *[f"`{old}` as `{new}`" for new, old in columns.items()]
        )

    @staticmethod
    def large(df: DataFrame) -> DataFrame:
        """A side of a join that grows with the server, such as its columns: joined by sorting.

        The planner takes a view's size from its files. Files that hold less than the view has rows look
        small enough to broadcast, and every task would hold the whole side in memory.
        """
        return df.hint("merge")

    def on(self, *columns: str) -> list[str]:
        """Join or group columns: the keys first."""
        return [*self.keys, *columns]

    def sort(self, df: DataFrame, *order: Column) -> DataFrame:
        return df.orderBy(*self.keys, *order) if self.ordered else df

    def setting(self, name: str, type: str) -> DataFrame:
        """One server setting, cast, as a column of its own name."""
        return (
            self.table("settings")
            .filter(F.col("name") == name)
            .select(*self.keys, F.col("setting").cast(type).alias(name))
        )

    def with_setting(self, df: DataFrame, name: str, type: str) -> DataFrame:
        return self.attach(df, self.setting(name, type), [name])

    def with_server_info(self, df: DataFrame, *columns: str) -> DataFrame:
        info = self.table("server_info").select(*self.keys, *columns)
        return self.attach(df, info, list(columns))

    def attach(self, df: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
        """Add columns of a table that has one row per key."""
        if self.keys:
            return df.join(values, self.keys, "left")
        # One server, one row: a scalar subquery each, no join at all.
        return df.withColumns({c: values.select(c).scalar() for c in columns})

    def user_schemas(self, *also_excluded: str) -> DataFrame:
        """(keys, nsp_oid, nspname) without the server's own schemas."""
        return self.pick("pg_namespace", nsp_oid="oid", nspname="nspname").filter(
            ~F.col("nspname").isin(*SYSTEM_SCHEMAS, *also_excluded)
        )

    def columns(self) -> DataFrame:
        """Columns a user can name: no system columns, none that were dropped."""
        live = ~F.coalesce("attisdropped", F.lit(False))
        return self.table("pg_attribute").filter((F.col("attnum") > 0) & live)

    def schemas(self) -> DataFrame:
        """(keys, nsp_oid, nspname) for every schema."""
        return self.pick("pg_namespace", nsp_oid="oid", nspname="nspname")


class _Landed(Mapping[str, DataFrame]):
    """Landed views, each listed and read only when a report asks for it."""

    def __init__(self, spark: SparkSession, root: str, since: str | None, until: str | None) -> None:
        self._spark, self._root, self._since, self._until = spark, root, since, until

    def __getitem__(self, view: str) -> DataFrame:
        if view not in self:
            raise KeyError(view)
        columns = {**KEYS, **view_columns(view), PARTITION: "date"}
        schema = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns.items()))
        df = self._spark.read.schema(schema).parquet(f"{self._root}/{view}")
        if self._since is not None:
            df = df.filter(F.col(PARTITION) >= F.lit(self._since).cast("date"))
        if self._until is not None:
            df = df.filter(F.col(PARTITION) <= F.lit(self._until).cast("date"))
        return df

    def __contains__(self, view: object) -> bool:
        context = self._spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{view}")
        return view in VIEWS and path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def __iter__(self) -> Iterator[str]:
        return (view for view in VIEWS if view in self)

    def __len__(self) -> int:
        return sum(1 for _ in self)

"""Column statistics of any DataFrame, from sketches that can be merged.

The reports on bloat and on null shares read ``null_frac`` and ``avg_width`` from a
server's statistics. Here they are measured: one pass over a table gives a row of
sketches per column; rows of several days, partitions or shards merge into one,
and statistics are read from the merged row without another look at the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.numbers import ratio
from fleetlens.plans.levels import cut_lineage, union_all

#: Distinct counts: 2^LG_K registers, a standard error of 1.04 / sqrt(2^LG_K), 0.8 %.
LG_K = 14
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)
#: Quantiles: a rank is off by less than RANK_ERROR with 99 % confidence.
KLL_K = 400
RANK_ERROR = 0.0083
#: Frequent values: a map of COMMON_MAP counters; the reported count of a value is its own or
#: up to COMMON_ERROR of all rows more, and no value more frequent than that is missed.
COMMON_TRACKED = 1500
COMMON_MAP = 2048
COMMON_ERROR = 3.5 / COMMON_MAP
#: Values of more bytes than this are not looked at as frequent ones.
WIDE = 1024

_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType)
_FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)

SKETCHES = (
    "attnum", "attname", "type", "ordered_as", "n_rows", "n_null", "n_bytes", "distinct_sketch", "long_sketch",
    "double_sketch", "common_sketch",
)


def _ordered_as(kind: T.DataType) -> str | None:
    if isinstance(kind, _WHOLE):
        return "long"
    if isinstance(kind, _FRACTIONS):
        return "double"
    if isinstance(kind, T.DateType):
        return "date"
    return "timestamp" if isinstance(kind, _TIMES) else None


def _aggregates(i: int, field: T.StructField) -> tuple[list[Column], Column]:
    """The aggregates of a column, and the struct that names them."""
    column = F.col("`" + field.name.replace("`", "``") + "`")
    kind, order = field.dataType, _ordered_as(field.dataType)
    text = F.hex(column) if isinstance(kind, T.BinaryType) else column.cast("string")
    bytes_ = F.lit(_FIXED_WIDTH[type(kind)]) if type(kind) in _FIXED_WIDTH else F.octet_length(
        column if isinstance(kind, (T.StringType, T.BinaryType)) else text
    )
    longs = {
        "long": column.cast("long"),
        "date": F.unix_date(column) if order == "date" else None,
        "timestamp": F.unix_micros(column.cast("timestamp")) if order == "timestamp" else None,
    }.get(order, F.lit(None).cast("long"))
    doubles = column.cast("double") if order == "double" else F.lit(None).cast("double")
    counted = column if isinstance(kind, (*_WHOLE, T.BinaryType)) else text
    parts = {
        "n_rows": F.count(F.lit(1)),
        "n_null": F.count_if(column.isNull()),
        "n_bytes": F.coalesce(F.sum(F.when(column.isNotNull(), bytes_).cast("long")), F.lit(0)),
        "distinct_sketch": F.hll_sketch_agg(counted, F.lit(LG_K)),
        "long_sketch": F.kll_sketch_agg_bigint(longs, F.lit(KLL_K)),
        "double_sketch": F.kll_sketch_agg_double(doubles, F.lit(KLL_K)),
        "common_sketch": F.call_function(
            "approx_top_k_accumulate", F.when(F.octet_length(text) <= WIDE, text), F.lit(COMMON_TRACKED)
        ),
    }
    named = F.struct(
        F.lit(i + 1).alias("attnum"), F.lit(field.name).alias("attname"), F.lit(kind.simpleString()).alias("type"),
        F.lit(order).cast("string").alias("ordered_as"), *[F.col(f"{name}_{i}").alias(name) for name in parts],
    )
    return [e.alias(f"{name}_{i}") for name, e in parts.items()], named


def column_sketches(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A row per column of ``df`` and value of ``keys``: counts and sketches.

    All columns are sketched by partial aggregates in one pass; a row leaves a
    task as a few kB per column, whatever the number of rows. ``keys`` are columns of
    ``df`` that say to which part a row belongs (a day, a cluster); they get no
    statistics. An empty table without keys has a row of zeros per column.
    """
    clash = set(keys) & {*SKETCHES, *STATISTICS}
    if clash:
        raise ValueError(f"rename the keys {sorted(clash)}")
    aggregates, rows = [], []
    for i, field in enumerate(f for f in df.schema.fields if f.name not in keys):
        own, row = _aggregates(i, field)
        aggregates += own
        rows.append(row)
    if not rows:
        raise ValueError("no columns besides the keys")
    return df.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(F.array(*rows)))


def merge_sketches(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of the union of all rows behind ``parts`` that share ``keys``.

    Columns are matched by name and type; the first position counts.
    """
    return (
        parts.groupBy(*keys, "attname", "type", "ordered_as")
        .agg(
            F.min("attnum").alias("attnum"),
            *[F.sum(n).alias(n) for n in ("n_rows", "n_null", "n_bytes")],
            F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
            F.kll_merge_agg_bigint("long_sketch").alias("long_sketch"),
            F.kll_merge_agg_double("double_sketch").alias("double_sketch"),
            F.call_function("approx_top_k_combine", F.col("common_sketch"), F.lit(COMMON_TRACKED)).alias("common_sketch"),
        )
        .select(*keys, *SKETCHES)
    )


STATISTICS = (
    "attnum", "attname", "type", "n_rows", "null_frac", "avg_width", "n_distinct", "common_vals", "common_freqs",
    "histogram_bounds",
)


def statistics_of(sketches: DataFrame, keys: Sequence[str] = (), common: int = 10, buckets: int = 10) -> DataFrame:
    """Statistics read from sketches, a row per column; see :func:`column_statistics`."""
    shares = F.array(*[F.lit(i / buckets) for i in range(buckets + 1)])
    longs = F.when(
        F.kll_sketch_get_n_bigint("long_sketch") > 0, F.kll_sketch_get_quantile_bigint("long_sketch", shares)
    )
    doubles = F.when(
        F.kll_sketch_get_n_double("double_sketch") > 0, F.kll_sketch_get_quantile_double("double_sketch", shares)
    )
    order = F.col("ordered_as")
    bounds = (
        F.when(order == "long", longs.cast("array<string>"))
        .when(order == "double", doubles.cast("array<string>"))
        .when(order == "date", F.transform(longs, lambda x: F.date_from_unix_date(x.cast("int")).cast("string")))
        .when(order == "timestamp", F.transform(longs, lambda x: F.timestamp_micros(x).cast("string")))
    )
    # One more than asked for, as null is a value to the sketch.
    found = F.call_function("approx_top_k_estimate", F.col("common_sketch"), F.lit(common + 1))
    # A count that the error alone can make up says nothing.
    exact = F.col("n_distinct") <= COMMON_TRACKED // 2
    kept = F.filter(
        found, lambda x: x["item"].isNotNull() & (exact | (x["count"] > 2 * COMMON_ERROR * F.col("n_rows")))
    )
    ordered = F.slice(F.array_sort(F.transform(kept, lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("item")))), 1, common)
    return (
        sketches.withColumn("n_distinct", F.hll_sketch_estimate("distinct_sketch"))
        .withColumn("common", ordered)
        .select(
            *keys, "attnum", "attname", "type", "n_rows",
            ratio(F.col("n_null"), F.col("n_rows")).alias("null_frac"),
            ratio(F.col("n_bytes"), F.col("n_rows") - F.col("n_null")).alias("avg_width"),
            "n_distinct",
            F.col("common.item").alias("common_vals"),
            F.transform("common.n", lambda n: ratio(-n, F.col("n_rows"))).alias("common_freqs"),
            bounds.alias("histogram_bounds"),
        )
    )


def column_statistics(df: DataFrame, keys: Sequence[str] = (), common: int = 10, buckets: int = 10) -> DataFrame:
    """Statistics of every column of ``df``, in one pass: ``(keys, attnum, attname, type,
    n_rows, null_frac, avg_width, n_distinct, common_vals, common_freqs, histogram_bounds)``.

    ``null_frac`` and ``avg_width`` are exact; the width is the mean number of bytes of
    the values that are not null (of their text, for nested types), null without such values.
    ``n_distinct`` has a standard error of ``DISTINCT_ERROR``. ``common_vals`` are up to
    ``common`` frequent values as text, most frequent first, with shares of all rows that are
    up to ``COMMON_ERROR`` too high; shares that can be error alone are left out, and so
    are values of over ``WIDE`` bytes. ``histogram_bounds``, for numbers, dates and times, are the
    smallest value, the ``buckets`` - 1 values between equal parts, off by less than
    ``RANK_ERROR`` in rank, and the largest value; null for other types.
    """
    return statistics_of(column_sketches(df, keys), keys, common, buckets)


def measured_views(tables: Mapping[str, tuple[DataFrame, Column | int]], schema: str = "public") -> dict[str, DataFrame]:
    """Catalog views of plain tables, so that the reports on bloat work on them.

    ``tables`` maps a name to a DataFrame and the number of pages it takes, which may
    be an expression over ``n_rows`` and ``row_bytes``, the mean bytes of a row. Every
    table is read once.
    """
    parts = [
        column_statistics(df).select(
            F.lit(i).cast("long").alias("relid"), F.lit(name).alias("relname"), F.lit(1).cast("long").alias("schema_id"), "attnum", "attname", "n_rows", "null_frac",
            "avg_width",
        )
        for i, (name, (df, _)) in enumerate(tables.items(), 1)
    ]
    columns = cut_lineage(union_all(parts))
    pages = F.lit(None).cast("long")
    for i, (_, size) in enumerate(tables.values(), 1):
        pages = F.when(F.col("oid") == i, size if isinstance(size, Column) else F.lit(size)).otherwise(pages)
    present = 1 - F.col("null_frac")
    relations = columns.groupBy(F.col("relid").alias("oid"), "relname", "schema_id").agg(
        F.max("n_rows").alias("n_rows"), F.sum(present * F.coalesce("avg_width", F.lit(0.0))).alias("row_bytes")
    )
    namespace = columns.select(F.col("schema_id").alias("oid")).distinct().withColumn("nspname", F.lit(schema))
    return {
        "pg_namespace": namespace,
        "pg_attribute": columns.select("relid", "attnum", "attname", F.lit(False).alias("attisdropped")),
        "pg_stats": columns.select(
            "relid", "attname", F.coalesce("null_frac", F.lit(0.0)).alias("null_frac"),
            F.round(F.coalesce("avg_width", F.lit(0.0))).alias("avg_width"),
        ),
        "pg_class": relations.select(
            "oid", "relname", F.col("schema_id").alias("relnamespace"), F.lit("r").alias("relkind"),
            F.lit(0).cast("long").alias("reltoastrelid"), F.col("n_rows").alias("reltuples"), pages.cast("long").alias("relpages"),
        ),
        "pg_stat_user_tables": relations.select(
            F.col("oid").alias("relid"), "relname", F.col("n_rows").alias("n_live_tup")
        ),
    }

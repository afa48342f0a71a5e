"""Pairing two tables when one key may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.levels import cut_lineage

#: Rows of one key and side that one task handles at most.
HOT_ROWS = 4096
#: A hot-key table is broadcast up to this many rows (about 20 MB), else shuffled.
BROADCAST_ROWS = 100_000

_HASH = "key_hash"
_AXES = {"columns": "cell_column", "rows": "cell_row"}


def equal_or_both_null(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: str,
    right_id: str,
    hot_rows: int = HOT_ROWS,
    tasks: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Inner join on null-safe ``keys``, splitting hot keys into a grid.

    The pairs of a key with *m* left and *n* right rows are m·n: far more work
    than its bytes in the shuffle tell, so adaptive skew handling, which goes by
    bytes, may leave it to one task. Here rows per key are counted first (one
    partial aggregate per side). A key with more than ``hot_rows`` rows on a side
    becomes a grid of cells, each at most about ``hot_rows`` × ``hot_rows``: a
    left row is given one column by the hash of ``left_id`` and copied to every
    row of the grid, a right row the other way round. Every pair meets in exactly
    one cell, so nothing is lost or repeated. Other keys are joined as usual.

    The result has the left columns, then the right ones without ``keys``; all
    other names must differ. ``tasks`` deals the cells over that many tasks, for pairs far larger
    than their sides: adaptive execution would merge the small shuffle into few. ``counts(keys, m, n)`` has
    the rows of each hot key on both sides, or more, where they are known; the sides are then not counted.
    """
    left = left.withColumn(_HASH, F.xxhash64(*keys))
    right = right.withColumn(_HASH, F.xxhash64(*keys))
    rows = _counts(left, right) if counts is None else counts.select(F.xxhash64(*keys).alias(_HASH), "m", "n")
    hot = cut_lineage(_hot_keys(rows, hot_rows))
    n_hot = hot.count()
    if n_hot == 0:
        return _join(left.drop(_HASH), right.drop(_HASH), keys, tasks)
    if n_hot <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    left = _place(left, hot, left_id, own="columns", copies="rows")
    right = _place(right, hot, right_id, own="rows", copies="columns")
    return _join(left, right, [*keys, *_AXES.values()], tasks).drop(*_AXES.values())


def _counts(left: DataFrame, right: DataFrame) -> DataFrame:
    m = left.select(_HASH, F.lit(1).alias("m"), F.lit(0).alias("n"))
    n = right.select(_HASH, F.lit(0).alias("m"), F.lit(1).alias("n"))
    return m.unionByName(n)


def _hot_keys(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Hashes of the keys with many rows: at most (rows of both) / ``hot_rows``.

    Counting by a hash keeps this pass narrow. Two keys with the same hash share
    a grid they may not need; the join itself still compares the keys.
    """
    counts = rows.groupBy(_HASH).agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    return counts.filter(
        (F.col("m") > 0) & (F.col("n") > 0) & (F.greatest("m", "n") > hot_rows)
    ).select(
        _HASH,
        F.ceil(F.col("m") / hot_rows).cast("int").alias("columns"),
        F.ceil(F.col("n") / hot_rows).cast("int").alias("rows"),
    )


def _place(df: DataFrame, hot: DataFrame, id_column: str, own: str, copies: str) -> DataFrame:
    """Give every row its cells: one on the ``own`` axis, all on the other."""
    columns = [c for c in df.columns if c != _HASH]
    marked = df.join(hot, _HASH, "left").select(
        *columns,
        F.coalesce(own, F.lit(1)).alias("own"),
        F.coalesce(copies, F.lit(1)).alias("copies"),
    )
    return marked.select(
        *columns,
        F.pmod(F.xxhash64(id_column), F.col("own")).cast("int").alias(_AXES[own]),
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(_AXES[copies]),
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    if tasks is not None:
        left = left.repartition(tasks, *keys)
    return left.join(right, equal_or_both_null(left, right, keys), "inner").select(
        *[left[c] for c in left.columns], *[right[c] for c in right.columns if c not in keys]
    )

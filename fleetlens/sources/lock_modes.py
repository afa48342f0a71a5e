"""Which lock modes exclude each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The table-level lock modes from weakest to strongest, each with
# the modes it conflicts with.
LOCK_CONFLICTS: dict[str, list[str]] = {
    "AccessShareLock": ["AccessExclusiveLock"],
    "RowShareLock": ["ExclusiveLock", "AccessExclusiveLock"],
    "RowExclusiveLock": [
        "ShareLock", "ShareRowExclusiveLock", "ExclusiveLock", "AccessExclusiveLock",
    ],
    "ShareUpdateExclusiveLock": [
        "ShareUpdateExclusiveLock", "ShareLock", "ShareRowExclusiveLock", "ExclusiveLock",
        "AccessExclusiveLock",
    ],
    "ShareLock": [
        "RowExclusiveLock", "ShareUpdateExclusiveLock", "ShareRowExclusiveLock",
        "ExclusiveLock", "AccessExclusiveLock",
    ],
    "ShareRowExclusiveLock": [
        "RowExclusiveLock", "ShareUpdateExclusiveLock", "ShareLock",
        "ShareRowExclusiveLock", "ExclusiveLock", "AccessExclusiveLock",
    ],
    "ExclusiveLock": [
        "RowShareLock", "RowExclusiveLock", "ShareUpdateExclusiveLock", "ShareLock",
        "ShareRowExclusiveLock", "ExclusiveLock", "AccessExclusiveLock",
    ],
    "AccessExclusiveLock": [
        "AccessShareLock", "RowShareLock", "RowExclusiveLock", "ShareUpdateExclusiveLock",
        "ShareLock", "ShareRowExclusiveLock", "ExclusiveLock", "AccessExclusiveLock",
    ],
}


def lock_conflicts(spark: SparkSession) -> DataFrame:
    """(requested, held), one row per conflicting pair: a fixed 38 rows."""
    pairs = [(r, h) for r, modes in LOCK_CONFLICTS.items() for h in modes]
    return spark.createDataFrame(pairs, "requested string, held string")

"""Writing and showing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.schemas import PARTITION


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a report, partitioned by snapshot date where it has a snapshot time.

    Dates that are written again replace what they held; other dates stay. So a
    job that is run twice leaves its rows once.

    The rebalance hint lets adaptive execution merge small partitions and split
    a date that holds most of the rows, so file sizes stay even.
    """
    if PARTITION not in df.columns and "snapshot_ts" in df.columns:
        df = df.withColumn(PARTITION, F.to_date("snapshot_ts"))
    if PARTITION in df.columns:
        df.hint("rebalance", PARTITION).write.format(fmt).mode(mode).option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(PARTITION).save(path)
    else:
        df.write.format(fmt).mode(mode).save(path)


def show(df: DataFrame, rows: int = 20, one_field_per_line: bool = False) -> None:
    """Print the first rows of a report."""
    df.show(rows, truncate=False, vertical=one_field_per_line)

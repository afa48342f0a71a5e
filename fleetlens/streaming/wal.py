"""Hourly log-file counts from a stream of file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.server import NOT_WAL


def wal_hourly_watch(
    stream: DataFrame, keys: Sequence[str] = ("cluster_id",), delay: str = "1 hour"
) -> DataFrame:
    """Log files per hour, one row per hour once the watermark has passed it."""
    return (
        stream.filter(~F.col("file_ls").isin(*NOT_WAL))
        .withColumn("modification", F.col("modification").cast("timestamp"))
        .withWatermark("modification", delay)
        .groupBy(F.window("modification", "1 hour").alias("span"), *keys)
        .agg(F.count(F.lit(1)).alias("wal_num"))
        .select(
            *keys,
            F.date_format("span.start", "yyyyMMdd").alias("day_id"),
            F.hour("span.start").alias("hour"),
            "wal_num",
        )
    )

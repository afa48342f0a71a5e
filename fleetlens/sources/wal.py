"""Directory listing of log files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def wal_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and modification time of the files below ``path``.

    The content column is never selected, so no file is opened.
    """
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file_ls"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modification"),
        )
    )

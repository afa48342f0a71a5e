"""Hourly log-file counts that can be written again, and the files that came too late.

Each batch writes what it adds under its own number and replaces what stands there,
so a batch that is run twice counts once. Readers sum over the batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.server import NOT_WAL

_PARTS = ("hours", "late", "marks")


def write_hours(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("cluster_id",), delay_seconds: int = 3600
) -> StreamingQuery:
    """Count the log files of ``stream(keys, file_ls, modification)`` by hour into ``target``.

    A file is late if its hour had ended ``delay_seconds`` or more before the newest file of
    all earlier batches. Late files are not counted; they stand whole in :func:`late_files`, so
    both together are all files. Processes what has arrived and stops.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, target, keys, delay_seconds)

    return (
        stream.writeStream.outputMode("update").foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def add_batch(batch: DataFrame, number: int, target: str, keys: Sequence[str], delay_seconds: int = 3600) -> None:
    """Put batch ``number`` into ``target``, in place of what it put there before."""
    spark = batch.sparkSession
    files = (
        batch.withColumn("modification", F.col("modification").cast("timestamp"))
        .filter(~F.col("file_ls").isin(*NOT_WAL) & F.col("modification").isNotNull())
        .withColumn("begins", F.date_trunc("hour", "modification"))
    )
    mark = _mark(spark, target, number)
    ends = F.unix_micros("begins") + F.lit(3600 * 1_000_000)
    late = F.lit(False) if mark is None else ends <= F.lit(mark - delay_seconds * 1_000_000)
    files = files.withColumn("is_late", late).persist()
    try:
        by_hour = [*keys, F.date_format("begins", "yyyyMMdd").alias("day_id"), F.hour("begins").alias("hour")]
        counted = files.filter("not is_late").groupBy(*by_hour).agg(F.count("*").alias("wal_num"))
        columns = [c for c in batch.columns if c not in {"day_id", "hour"}]
        parts = {
            "hours": counted,
            "late": files.filter("is_late").select(*columns, *by_hour[len(keys) :]),
            "marks": files.agg(F.max(F.unix_micros("modification")).alias("mark")),
        }
        for part in _PARTS:
            parts[part].write.mode("overwrite").parquet(f"{target}/{part}/batch={number}")
    finally:
        files.unpersist()


def _mark(spark: SparkSession, target: str, before: int) -> int | None:
    """The newest file's time in all batches before ``before``."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{target}/marks")
    if not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
        return None
    marks = spark.read.schema("mark bigint, batch bigint").parquet(f"{target}/marks")
    return marks.filter(F.col("batch") < before).agg(F.max("mark")).first()[0]


def hours(spark: SparkSession, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, day_id, hour, wal_num)`` over all batches."""
    return spark.read.parquet(f"{target}/hours").groupBy(*keys, "day_id", "hour").agg(F.sum("wal_num").alias("wal_num"))


def late_files(spark: SparkSession, target: str) -> DataFrame:
    """Every late file with its hour, and the batch that brought it."""
    return spark.read.parquet(f"{target}/late")

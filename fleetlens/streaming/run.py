"""Sources and sinks of the streaming reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def snapshot_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    """Landed Parquet files as a stream, in order of arrival."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def write_stream(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append finished rows to Parquet, exactly once over restarts.

    ``every`` is a processing interval; without it all that has arrived is
    processed and the query stops.
    """
    writer = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()

"""Files of a folder, without their contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_of(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``(file, size, modification)`` of the files in ``path`` whose names match ``glob``.

    Only the listing is read. Subfolders count with ``recursive``; ``file`` is the
    bare name in any case.
    """
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"),
            F.col("modificationTime").alias("modification"),
        )
    )

"""Level-by-level walks over edge tables.

Each level is a join of the previous level with the edges, checkpointed to
reliable storage: the plan of a level does not contain the levels before it, a
lost executor costs one level at most, and rows never pass the driver. The loop
ends with the first empty level.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


#: With it Spark removes the shuffle files of a query when the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables that :func:`stow_rows` made.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="fleetlens-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the checkpoint folder, drop its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_rows(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back.

    For loops that join their own results: a checkpointed table keeps the planner's
    guess of its size, a product of the sides of its joins, so that the number
    doubles its digits in every round; a written table has its real size. The
    files stay, as ``rows-*``, until the owner of the folder clears them.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stow_rows(df: DataFrame) -> DataFrame:
    """:func:`keep_rows` on as little disk as can be: the table is packed closer, and the shuffles it
    was made with go at once instead of when the driver collects garbage. :func:`drop_rows` deletes it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    try:
        spark.conf.set(FREE_SHUFFLES, "true")
        df.write.parquet(path, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    stowed = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[stowed] = path
    return stowed


def drop_rows(*tables: DataFrame) -> None:
    """Delete tables of :func:`stow_rows` that nothing unfinished reads."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(table))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def walk_levels(
    seed: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    max_levels: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> list[DataFrame]:
    """Levels 1, 2, … from ``seed``; ``step(level, n)`` gives level ``n + 1``.

    ``max_levels`` is a limit the report itself asks for. Without it the walk
    goes on to the end, so ``step`` has to stop at cycles. ``keep`` stores a level.
    """
    level = keep(seed)
    levels = [level]
    depth = 1
    while (max_levels is None or depth < max_levels) and not level.isEmpty():
        level = keep(step(level, depth))
        levels.append(level)
        depth += 1
    return levels


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

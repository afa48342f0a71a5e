"""Sort orders with NULL as the largest value, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def up(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def down(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()

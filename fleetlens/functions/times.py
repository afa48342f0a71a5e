"""Differences between instants. Times are TIMESTAMP, results plain seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``.

    Plain elapsed seconds: months and days have no calendar meaning here.
    """
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def exact_seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` with the fraction, as a double."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)

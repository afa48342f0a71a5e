"""Integer, rounding, transaction-id and log-position arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XID_SPAN = 1 << 32
XID_HALF = 1 << 31
#: Age of the reserved ids 0, 1 and 2, which never take part in wrap-around.
RESERVED_XID_AGE = XID_HALF - 1


def int_div(a: Column, b: Column) -> Column:
    """Truncating integer division; NULL instead of an error for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """Fractional division; NULL instead of an error for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a percentage of ``whole``, halves rounded away from zero.

    The multiplication comes first: a quotient that is a decimal tie then is
    the double nearest to that decimal, and rounds the right way.
    """
    return F.round(ratio(part * F.lit(100), whole), digits)


def to_whole(x: Column) -> Column:
    """Fraction to integer the way a float cast does it: nearest, ties to even."""
    return F.bround(x.cast("double"), 0).cast("bigint")


def align_pad(x: Column, unit: int) -> Column:
    """``x`` lifted by one whole ``unit`` less its overhang.

    An ``x`` already on a boundary is left alone, others move up to the next
    one.
    """
    overhang = x % F.lit(unit)
    return x + F.lit(unit) - F.when(overhang == 0, F.lit(unit)).otherwise(overhang)


def xid_age(next_xid: Column, xid: Column) -> Column:
    """Distance from ``xid`` to the next id on the 32-bit circle."""
    distance = F.pmod(next_xid - xid + F.lit(XID_HALF), F.lit(XID_SPAN)) - F.lit(XID_HALF)
    return F.when(xid < 3, F.lit(RESERVED_XID_AGE).cast("bigint")).otherwise(distance)


def lsn_to_long(lsn: Column) -> Column:
    """Byte offset of a log position written as two hex halves, ``16/B374D848``."""
    halves = F.split(lsn, "/")
    high = F.conv(F.get(halves, F.lit(0)), 16, 10).cast("bigint")
    low = F.conv(F.get(halves, F.lit(1)), 16, 10).cast("bigint")
    return high * F.lit(XID_SPAN) + low


def spread_absent(reference: Column, own_id: Column) -> Column:
    """A reference id for joining, its absent values (NULL or 0) made distinct.

    Rows that refer to nothing would all hash to one partition. Ids are
    positive, so the negative of the row's own id matches nothing either, and
    spreads.
    """
    return F.when(F.coalesce(reference, F.lit(0)) == 0, -own_id).otherwise(reference)

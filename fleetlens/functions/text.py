"""Text rendering: sizes, identifiers, rows, spans of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit names in rising order; each is 1024 times the one before.
SIZE_UNITS = ["bytes", "kB", "MB", "GB", "TB", "PB"]


def human_bytes(size: Column) -> Column:
    """Whole-number size with a unit; a unit is used below 10240 of it.

    From kB on the value is rounded half up, so the change to the next unit
    comes at 10239.5 of the current one.
    """
    size = size.cast("bigint")
    last = len(SIZE_UNITS) - 1
    pieces = F.when(F.abs(size) < 10240, F.concat(size.cast("string"), F.lit(" bytes")))
    for power in range(1, last + 1):
        # `halves` counts half units: one bit less than the unit itself.
        halves = F.call_function("div", size, F.lit(1 << (10 * power - 1)))
        rounded = F.call_function(
            "div", halves + F.when(halves < 0, -1).otherwise(1), F.lit(2)
        )
        label = F.concat(rounded.cast("string"), F.lit(" " + SIZE_UNITS[power]))
        fits = F.abs(halves) < 2 * 10240 - 1
        pieces = pieces.when(fits, label) if power < last else pieces.otherwise(label)
    return F.when(size.isNotNull(), pieces)


def concat_skip_null(*parts: Column | str) -> Column:
    """Concatenation in which NULL parts vanish. Plain strings are literals."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def quote_identifier(name: Column) -> Column:
    """Identifier, double-quoted unless it is plain lower case."""
    plain = name.rlike("^[a-z_][a-z0-9_$]*$")
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(plain, name).otherwise(quoted)


def row_text(df: DataFrame) -> Column:
    """Text of a whole row, ``(1,abc,"two words",)``.

    NULL fields are empty; a field is quoted when it is the empty string or
    holds a comma, parenthesis, quote, backslash or white space.
    """

    def field(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        doubled = F.replace(
            F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')
        )
        risky = (value == "") | value.rlike(r'[\s,()"\\]')
        return F.coalesce(
            F.when(risky, F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(value), F.lit("")
        )

    return F.concat(F.lit("("), F.concat_ws(",", *[field(n) for n in df.columns]), F.lit(")"))


def progress_text(done: Column, total: Column) -> Column:
    """``12.50% (1 of 8)``, with N/A and ? where a number is missing."""
    share = F.round(F.try_divide(done * F.lit(100.0), total), 2).cast("decimal(20,2)")
    return F.concat(
        F.coalesce(F.concat(share.cast("string"), F.lit("%")), F.lit("N/A")),
        F.lit(" ("),
        F.coalesce(done.cast("string"), F.lit("?")),
        F.lit(" of "),
        F.coalesce(total.cast("string"), F.lit("?")),
        F.lit(")"),
    )


def span_text(seconds: Column) -> Column:
    """Seconds as ``[N day(s) ]HH:MM:SS``."""
    days = F.call_function("div", seconds, F.lit(86400))
    rest = seconds - days * F.lit(86400)
    day_part = F.when(days == 1, F.lit("1 day ")).when(
        days != 0, F.concat(days.cast("string"), F.lit(" days "))
    )

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    clock = F.concat(
        F.when(rest < 0, F.lit("-")).otherwise(F.lit("")),
        two(F.call_function("div", F.abs(rest), F.lit(3600))),
        F.lit(":"),
        two(F.call_function("div", F.abs(rest) % 3600, F.lit(60))),
        F.lit(":"),
        two(F.abs(rest) % 60),
    )
    return F.when(seconds.isNotNull(), F.concat(F.coalesce(day_part, F.lit("")), clock))

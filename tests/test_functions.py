from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import numbers, order, text, times
from tests.helpers import values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("size", "shown"),
    [
        (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10751, "10 kB"), (10752, "11 kB"),
        ((1 << 20) - 1, "1024 kB"), (10485247, "10239 kB"), (10485248, "10 MB"), (20 << 40, "20 TB"),
        (10 << 40, "10 TB"), (1 << 60, "1024 PB"), (-10239, "-10239 bytes"), (-10240, "-10 kB"), (None, None),
    ],
)
def test_human_bytes(spark, size, shown):
    assert one(spark, text.human_bytes(F.lit(size).cast("bigint"))) == shown


@pytest.mark.parametrize(("x", "padded"), [(0, 0), (1, 8), (7, 8), (8, 8), (9, 16), (24, 24)])
def test_align_pad(spark, x, padded):
    assert one(spark, numbers.align_pad(F.lit(x), 8)) == padded


@pytest.mark.parametrize(
    ("next_xid", "xid", "age"),
    [
        (100, 0, 2147483647), (100, 1, 2147483647), (100, 2, 2147483647), (100, 3, 97),
        (100, 4294967290, 106), (2147483751, 103, -2147483648), (103, 2147483751, -2147483648), (50, 60, -10),
    ],
)
def test_xid_age(spark, next_xid, xid, age):
    column = numbers.xid_age(F.lit(next_xid).cast("bigint"), F.lit(xid).cast("bigint"))
    assert one(spark, column) == age


def test_lsn_to_long(spark):
    assert one(spark, numbers.lsn_to_long(F.lit("16/B374D848"))) == 0x16B374D848
    assert one(spark, numbers.lsn_to_long(F.lit("0/0"))) == 0
    assert one(spark, numbers.lsn_to_long(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("x", "whole"), [(0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (2.6, 3)])
def test_to_whole_breaks_ties_to_even(spark, x, whole):
    assert one(spark, numbers.to_whole(F.lit(x))) == whole


def test_percent_rounds_away_from_zero_and_survives_zero(spark):
    assert one(spark, numbers.percent(F.lit(1), F.lit(16), 1)) == 6.3
    assert one(spark, numbers.percent(F.lit(1), F.lit(200), 0)) == 1.0
    assert one(spark, numbers.percent(F.lit(1), F.lit(0), 1)) is None


def test_int_div_truncates_and_survives_zero(spark):
    assert one(spark, numbers.int_div(F.lit(7), F.lit(2))) == 3
    assert one(spark, numbers.int_div(F.lit(-7), F.lit(2))) == -3
    assert one(spark, numbers.int_div(F.lit(7), F.lit(0))) is None


def test_spread_absent(spark):
    df = spark.createDataFrame([(5, 1), (0, 2), (None, 3)], "ref bigint, own bigint")
    assert values(df.select(numbers.spread_absent(F.col("ref"), F.col("own")).alias("x")), "x") == [5, -2, -3]


def test_concat_skip_null(spark):
    assert one(spark, text.concat_skip_null("a", F.lit(None).cast("string"), F.lit(7))) == "a7"


@pytest.mark.parametrize(
    ("name", "quoted"), [("db0", "db0"), ("My", '"My"'), ('a"b', '"a""b"'), ("1a", '"1a"'), ("a b", '"a b"')]
)
def test_quote_identifier(spark, name, quoted):
    assert one(spark, text.quote_identifier(F.lit(name))) == quoted


def test_row_text(spark):
    df = spark.createDataFrame(
        [(1, "plain", None), (2, "", 'say "hi"'), (3, "a,b", "back\\slash"), (4, "(x)", "t\tb")],
        "n int, a string, b string",
    )
    assert values(df.select(text.row_text(df).alias("t")), "t") == [
        "(1,plain,)", '(2,"","say ""hi""")', '(3,"a,b","back\\\\slash")', '(4,"(x)","t\tb")',
    ]


@pytest.mark.parametrize(
    ("done", "total", "shown"),
    [
        (1, 8, "12.50% (1 of 8)"), (0, 5, "0.00% (0 of 5)"), (5, 5, "100.00% (5 of 5)"), (1, 3, "33.33% (1 of 3)"),
        (1, 0, "N/A (1 of 0)"), (None, 4, "N/A (? of 4)"), (None, None, "N/A (? of ?)"),
    ],
)
def test_progress_text(spark, done, total, shown):
    column = text.progress_text(F.lit(done).cast("bigint"), F.lit(total).cast("bigint"))
    assert one(spark, column) == shown


@pytest.mark.parametrize(
    ("seconds", "shown"),
    [(0, "00:00:00"), (3661, "01:01:01"), (86400, "1 day 00:00:00"), (200000, "2 days 07:33:20"), (None, None), (-5, "-00:00:05")],
)
def test_span_text(spark, seconds, shown):
    assert one(spark, text.span_text(F.lit(seconds).cast("bigint"))) == shown


def test_seconds(spark):
    a, b = F.lit("2024-01-31 00:00:00.5").cast("timestamp"), F.lit("2024-03-01 00:00:01").cast("timestamp")
    assert one(spark, times.seconds_between(a, b)) == 30 * 86400 + 1
    assert one(spark, times.exact_seconds_between(a, b)) == 30 * 86400 + 0.5


def test_null_is_the_largest_value_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert values(df.orderBy(order.up("x")), "x") == [1, 2, None]
    assert values(df.orderBy(order.down("x")), "x") == [None, 2, 1]

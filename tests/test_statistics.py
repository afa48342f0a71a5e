"""Column statistics: exact where exact, sketches within their bounds, mergeable."""

from __future__ import annotations

import bisect
import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.statistics import (
    COMMON_ERROR, DISTINCT_ERROR, RANK_ERROR, WIDE, column_sketches, column_statistics, merge_sketches, statistics_of,
)
from tests.conftest import SF


def by_column(df):
    return {r["attname"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows hold one value, the other values are all different."""
    n = 60_000
    return spark.range(n).repartition(5).select(
        F.col("id"), (F.pow(F.col("id"), 2) % 9973).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 == 1, "warm").otherwise(F.col("id").cast("string")).alias("s"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("sparse"),
    )


def test_sketches_are_within_their_bounds(skewed):
    rows, n = skewed.collect(), skewed.count()
    got = by_column(column_statistics(skewed, common=3, buckets=20))
    for name in ("id", "x", "s", "sparse"):
        exact = len({r[name] for r in rows} - {None})
        assert abs(got[name]["n_distinct"] - exact) <= 4 * DISTINCT_ERROR * exact + 1
    for name in ("id", "x", "sparse"):
        values = sorted(r[name] for r in rows if r[name] is not None)
        bounds = [type(values[0])(b) for b in got[name]["histogram_bounds"]]
        assert bounds[0] == values[0] and bounds[-1] == values[-1] and bounds == sorted(bounds)
        for i, b in enumerate(bounds):
            low, high = bisect.bisect_left(values, b) / len(values), bisect.bisect_right(values, b) / len(values)
            assert low - 2 * RANK_ERROR <= i / 20 <= high + 2 * RANK_ERROR
    counts = Counter(r["s"] for r in rows)
    common = dict(zip(got["s"]["common_vals"], got["s"]["common_freqs"], strict=True))
    assert {"hot", "warm"} <= set(common)
    for value, share in common.items():
        assert counts[value] / n <= share + 1e-12 <= counts[value] / n + COMMON_ERROR + 1e-9
    assert got["s"]["histogram_bounds"] is None and got["sparse"]["null_frac"] == 0.75


def test_merged_sketches_are_those_of_all_rows(skewed):
    keyed = skewed.withColumn("day", F.col("id") % 3)
    parts = column_sketches(keyed, ["day"])
    assert parts.count() == 3 * 4
    merged = by_column(statistics_of(merge_sketches(parts)))
    whole = by_column(column_statistics(skewed))
    assert merged.keys() == whole.keys()
    for name, row in whole.items():
        for exact in ("n_rows", "null_frac", "avg_width", "attnum", "type"):
            assert merged[name][exact] == row[exact]
        assert abs(merged[name]["n_distinct"] - row["n_distinct"]) <= 8 * DISTINCT_ERROR * row["n_distinct"] + 1
    again = merge_sketches(merge_sketches(parts, ["day"]), [])
    assert by_column(again)["s"]["n_rows"] == whole["s"]["n_rows"]
    per_day = statistics_of(parts, ["day"]).filter("attname = 'id'").collect()
    assert sorted((r["day"], r["n_rows"]) for r in per_day) == [(0, 20_000), (1, 20_000), (2, 20_000)]


def test_every_type_has_statistics(spark):
    rows = [
        (True, 1, 1.5, "é", bytearray(b"ab"), dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3), [1, 2], None, "x" * (WIDE + 1)),
        (None, 3, float("nan"), "", None, dt.date(1960, 1, 2), None, None, None, "x" * (WIDE + 1)),
        (True, 2, None, None, bytearray(b"cd"), None, dt.datetime(2021, 1, 2, 3), [], None, "y"),
    ]
    schema = "b boolean, i int, d double, s string, raw binary, day date, ts timestamp, arr array<int>, nothing string, `we``ird.name` string"
    df = spark.createDataFrame(rows, schema)
    got = by_column(column_statistics(df))
    assert list(got) == [f.name for f in df.schema.fields] and [r["attnum"] for r in got.values()] == list(range(1, 11))
    assert (got["b"]["n_distinct"], got["b"]["common_vals"], got["b"]["common_freqs"]) == (1, ["true"], [2 / 3])
    assert got["i"]["histogram_bounds"][0] == "1" and got["i"]["histogram_bounds"][-1] == "3" and got["i"]["avg_width"] == 4
    assert got["s"]["avg_width"] == 1.0 and got["raw"]["avg_width"] == 2.0
    assert got["day"]["histogram_bounds"][0] == "1960-01-02" and got["ts"]["histogram_bounds"][-1] == "2021-01-02 03:00:00"
    assert (got["nothing"]["null_frac"], got["nothing"]["avg_width"], got["nothing"]["n_distinct"]) == (1.0, None, 0)
    assert got["nothing"]["common_vals"] == [] and got["we`ird.name"]["common_vals"] == ["y"]
    empty = by_column(column_statistics(df.filter("false")))
    assert len(empty) == 10 and all(r["n_rows"] == 0 and r["null_frac"] is None and r["n_distinct"] == 0 for r in empty.values())
    assert column_statistics(df.filter("false"), ["i"]).count() == 0
    with pytest.raises(ValueError):
        column_sketches(df.withColumnRenamed("i", "attname"), ["attname"])


def test_one_pass_with_partial_aggregates(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = column_statistics(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "partial_hll_sketch_agg" in plan

"""What the plans look like."""

from __future__ import annotations

import pytest

from checks.queries import QUERIES
from tests.conftest import SF

BATCH = [n for n in QUERIES if n.startswith("r")]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_of_all_rows_and_no_python(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_top_names_of_a_group_are_limited_before_the_shuffle(spark):
    plan = physical(QUERIES["r10_duplicate_indexes"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_k_is_one_bounded_step(spark):
    assert "TakeOrderedAndProject" in physical(QUERIES["r27_oldest_relations"](spark, SF))


def test_wal_hours_take_one_shuffle_besides_the_sort(spark):
    plan = physical(QUERIES["r37_wal_hourly"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1


def test_only_needed_columns_are_read(spark):
    plan = physical(QUERIES["r24_wait_events"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint>" in plan

"""Every report against its DuckDB twin."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: SQL over the views cannot name their folder; ``test_publish.py`` compares the listing.
NO_SQL = {"s3_table_files"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in NO_SQL])
def test_query_matches_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_every_report_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) | NO_SQL
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert not entry(spark).isEmpty()

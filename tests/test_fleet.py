"""Two clusters that share every id: reports must not mix them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import pytest
from pyspark.sql import functions as F

from checks.fixtures import NOW, catalog
from checks.queries import plain
from fleetlens import Catalog
from fleetlens.plans.bundles import BUNDLES, bundle
from tests.conftest import SF

#: Views of the test catalog that are one row per cluster already.
PER_CLUSTER = {"checkpoint", "wal_archive"}


class Twice(Mapping):
    def __init__(self, single):
        self.single = single

    def __getitem__(self, view):
        df = self.single[view]
        return df.withColumn("cluster_id", F.lit("a")).unionByName(df.withColumn("cluster_id", F.lit("b")))

    def __iter__(self):
        return iter(self.single)

    def __len__(self):
        return len(self.single)


@pytest.mark.parametrize("command", [b for b in BUNDLES if b not in PER_CLUSTER])
def test_bundle_of_two_clusters(spark, command):
    chain = {"pg_locks": "locks_chain"} if command == "lock" else {}
    one = catalog(spark, SF, **chain)
    two = Catalog(Twice(one._tables), keys=["cluster_id"], now=F.lit(NOW).cast("timestamp"))
    single, double = bundle(one, command), bundle(two, command)
    assert list(single) == list(double) == [name for name, _, _ in BUNDLES[command]]
    for name, df in single.items():
        columns = [n for n in df.columns if n != "cluster_id"]
        expected = Counter(tuple(r) for r in plain(df.select(columns)).collect())
        for cluster in "ab":
            rows = double[name].filter(F.col("cluster_id") == cluster).select(columns)
            assert Counter(tuple(r) for r in plain(rows).collect()) == expected, (name, cluster)


@pytest.mark.parametrize("command", sorted(PER_CLUSTER))
def test_bundle_keyed_by_the_data(spark, command):
    c = catalog(spark, SF, keys=("cluster_id",), settings="cluster_settings", server_info="cluster_info")
    for df in bundle(c, command).values():
        assert df.count() == df.select("cluster_id").distinct().count() == 25


def test_bundle_arguments(spark):
    c = catalog(spark, SF)
    assert bundle(c, "relation", schema="app")["relation_sizes"].filter("table_schema <> 'app'").isEmpty()
    assert list(bundle(c, "wal_generate", version=14)) == ["wal_hourly"]
    assert "pending" in bundle(c, "replication", version=9)["replication_lag"].columns
    with pytest.raises(TypeError):
        bundle(c, "relation", role="x")
    with pytest.raises(ValueError, match="unknown command"):
        bundle(c, "nothing")

"""Plans and rows of reports whose work has to grow with their input, or their result."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from checks.fixtures import catalog
from fleetlens.operators import access, bloat, indexes, locks
from tests.conftest import SF
from tests.helpers import small_catalog, values


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_privileges_are_made_by_the_last_join(spark):
    """Tables and roles of one class, repeated rows, nulls, cycles: as counted by hand, and no
    aggregate over the pairs of role and table."""
    r = random.Random(3)
    tables = [{"oid": i, "relname": f"t{i}", "relnamespace": 1 + i % 2, "relkind": "r", "relowner": 20 + i % 3} for i in range(1, 13)]
    tables += [tables[0], {"oid": None, "relname": "x", "relnamespace": 1, "relkind": "r", "relowner": 20}]
    roles = [{"oid": i, "rolname": f"r{i}", "rolsuper": False} for i in range(20, 50)] + [{"oid": 20, "rolname": "again"}, {"oid": 50}]
    members = [{"member": m, "roleid": r.randrange(20, 26)} for m in range(20, 51)] + [{"member": 20, "roleid": 21}, {"member": None, "roleid": 20}]
    grants = [{"relid": r.randrange(1, 14), "grantee": r.choice([0, 20, 21, 22, 30, None]), "perm": r.choice(["SELECT", "TRIGGER", "odd"])} for _ in range(60)]
    c = small_catalog(spark, pg_class=tables, pg_roles=roles, pg_auth_members=members, table_grants=grants)
    holds = {(t["oid"], t["relowner"], p) for t in tables for p in access.TABLE_PRIVILEGES}
    holds |= {(g["relid"], g["grantee"], g["perm"]) for g in grants if g["perm"] != "odd"}
    up = {m["member"]: set() for m in members}
    for m in members:
        up[m["member"]].add(m["roleid"])
    while (wider := {m: a.union(*[up.get(x, set()) for x in a]) for m, a in up.items()}) != up:
        up = wider
    expected = Counter()
    for user, name in [(x["oid"], x.get("rolname")) for x in roles] + [(0, "PUBLIC")]:
        for t in tables:
            mine = {p for o, role, p in holds if o == t["oid"] and role in {user, *up.get(user, ())}}
            if name is not None and t["oid"] is not None:
                expected.update((name, ["public", "app"][t["relnamespace"] - 1], t["relname"], p) for p in mine)
    found = access.effective_privileges(c)
    assert Counter(values(found, "user_name", "table_schema", "table_name", "privilege_type")) == expected
    c.ordered = False
    assert "Aggregate" not in plan(access.effective_privileges(c))


@pytest.mark.parametrize(("report", "sides"), [
    (indexes.high_null_indexes, 2), (indexes.index_columns, 2), (bloat.index_key_widths, 2), (bloat.index_bloat, 3), (access.view_dependencies, 2),
])
def test_columns_of_all_tables_are_never_broadcast(spark, report, sides):
    """A column view has several rows for one of its file: its size as read from the file misleads the planner."""
    assert plan(report(catalog(spark, SF))).count("strategy=merge") == sides


def test_trees_of_the_lock_report_meet_the_sessions_once(spark):
    """What is said of a session is found before, not joined to every row of the trees piece by piece."""
    assert plan(locks.lock_report(catalog(spark, SF))).count("Join") == 1


def test_locks_at_the_targets_are_found_once(spark):
    c = catalog(spark, SF)
    assert "Aggregate" not in plan(locks.class_pairs(c, locks.lock_classes(c).filter("n_pairs > 0")))


def test_pairs_of_indexes_are_made_by_the_last_join(spark):
    joins = [x for x in plan(indexes.contained_indexes(catalog(spark, SF))).splitlines() if "Join" in x]
    assert "right_columns" in joins[0]


@pytest.mark.parametrize("hot_rows", [4096, 3])
def test_contained_indexes_against_all_pairs(spark, hot_rows):
    """Tables with many indexes over few column sets, predicates, expressions, system schemas, nulls."""
    r = random.Random(12)
    tables = [{"oid": i, "relname": f"t{i}", "relnamespace": 1 + i % 3} for i in range(1, 7)]
    rows = [
        {"indexrelid": r.choice([None, *[i] * 20]), "indrelid": r.choice([1, 1, 1, 2, 3, 4, None]), "indexname": f"i{i}", "index_bytes": i % 7,
         "indkey": r.choice(["1", "1", "1 2", "2 1", "2 1 1", "3", "4 2 1", "0 1", None]), "indpred": r.choice([None, None, "x"]),
         "amname": r.choice(["btree", "BTREE", "gin"]), "indisunique": i % 2 == 0}
        for i in range(90)
    ]
    c = small_catalog(spark, pg_index=rows, pg_class=tables)
    usable = [x for x in rows if x["amname"].lower() == "btree" and x["indkey"] and "0" not in x["indkey"] and None not in (x["indexrelid"], x["indrelid"])]
    key = lambda x: set(x["indkey"].split())
    expected = Counter(
        (["public", "app"][x["indrelid"] % 3], f"t{x['indrelid']}", x["indexname"], x["indisunique"], x["index_bytes"], y["indexname"], key(x) == key(y))
        for x in usable for y in usable
        if x["indrelid"] == y["indrelid"] and x["indrelid"] % 3 != 2 and y["indpred"] is None and x is not y
        and (key(x) < key(y) or key(x) == key(y) and x["indexrelid"] > y["indexrelid"])
    )
    found = indexes.contained_indexes(c, hot_rows)
    assert Counter(values(found, "schema", "table", "index", "indisunique", "index_bytes", "contained_in", "same_columns")) == expected
    assert len(expected) > 100

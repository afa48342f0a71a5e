"""Closures, components, subtree totals and containment against plain walks."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from fleetlens.operators import access, indexes, locks, partitions
from fleetlens.plans.containment import contained_in
from fleetlens.plans.graphs import least_before, strong_components, transitive_closure, tree_totals
from tests.helpers import lock, sessions, small_catalog, values, waits_for


def reach(edges):
    """All pairs with a way between them."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = set()
    for start in list(after):
        todo, seen = list(after[start]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out |= {(start, x) for x in seen}
    return out


def random_edges(seed, n=25, m=35):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def table(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize("seed", [1])
def test_closure_of_random_graphs(spark, seed):
    edges = random_edges(seed) + [(1, None), (None, 2)]
    found = values(transitive_closure(table(spark, edges)), "a", "b")
    assert len(found) == len(set(found)) and set(found) == reach(e for e in edges if None not in e)


def test_a_chain_of_a_thousand_takes_few_rounds(spark):
    trace = []
    closure = transitive_closure(spark.range(999).selectExpr("id as a", "id + 1 as b"), trace=trace)
    assert closure.count() == 1000 * 999 // 2 and len(trace) <= 11
    assert all(steps < 1000 for _, steps in trace)


def test_closure_keeps_clusters_apart_and_ends_in_a_cycle(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 3, 4)], "k long, a long, b long")
    assert sorted(values(transitive_closure(edges, ["k"]), "k", "a", "b")) == [(1, a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(2, 3, 4)]
    assert transitive_closure(edges.filter("false"), ["k"]).count() == 0


@pytest.mark.parametrize("growth", [0, 8])
def test_the_smallest_node_before(spark, growth):
    edges = random_edges(4, 30, 40) + [(100 + i, 101 + i) for i in range(9)]
    ways = reach(edges)
    nodes = {x for e in edges for x in e}
    expected = {x: min([x, *(a for a, b in ways if b == x)]) for x in nodes}
    assert dict(values(least_before(table(spark, edges), growth=growth), "node", "least")) == expected


@pytest.mark.parametrize("seed", [3])
def test_components_of_random_graphs(spark, seed):
    edges = random_edges(seed, 22, 34)
    ways = reach(e for e in edges if e[0] != e[1])
    expected = {a: min(y for x, y in ways if x == a and (y, a) in ways) for a, b in ways if a != b and (b, a) in ways}
    assert dict(values(strong_components(table(spark, edges)), "node", "component")) == expected


def test_two_large_cycles_joined_by_a_path_come_out_apart(spark):
    ring = lambda first, n: [(first + i, first + (i + 1) % n) for i in range(n)]
    path = [(12, 201), (201, 202), (202, 203), (203, 100)]
    tail = [(300 + i, 301 + i) for i in range(5)] + [(305, 3)]
    found = dict(values(strong_components(table(spark, ring(0, 24) + ring(100, 15) + path + tail)), "node", "component"))
    assert found == {**{i: 0 for i in range(24)}, **{i: 100 for i in range(100, 115)}}
    assert strong_components(table(spark, path + [(5, 5)])).count() == 0


def test_deadlocks_of_two_clusters(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (5, 6), (6, 5), (7, 4)]
    more = {"cluster_id": 2}
    rows = waits_for(edges) + [{**r, **more} for r in waits_for([(1, 2), (2, 9)])]
    c = small_catalog(spark, ("cluster_id",), pg_locks=rows, pg_stat_activity=sessions(*range(1, 8)) + sessions(1, 2, 9, **more))
    assert values(locks.deadlocks(c), "cluster_id", "deadlock", "sessions", "waiter", "holder", "waiter_user") == [
        (1, 1, 3, 1, 2, "u1"), (1, 1, 3, 2, 3, "u2"), (1, 1, 3, 3, 1, "u3"), (1, 5, 2, 5, 6, "u5"), (1, 5, 2, 6, 5, "u6"),
    ]


def test_classes_multiply_to_the_pairs(spark):
    r = random.Random(8)
    rows = [lock(r.randrange(12), r.choice([1, 2, 3, None]), r.random() < 0.4) for _ in range(60)] + [lock(99, 1, False)]
    c = small_catalog(spark, pg_locks=rows, pg_stat_activity=sessions(*range(12)))
    for granted in (False, True):
        classes = locks.lock_classes(c, granted)
        pairs = sorted(values(locks.lock_pairs(c, granted), "blocked_pid", "blocking_pid"))
        assert sum(values(classes, "n_pairs")) == len(pairs) > 50
        assert sorted(values(locks.class_pairs(c, classes, granted), "blocked_pid", "blocking_pid")) == pairs
        by_blocker = {p: sum(b == p for _, b in pairs) for p in range(12)}
        assert dict(values(locks.top_blockers(c, granted).filter("n_blocked > 0"), "pid", "n_blocked")) == {p: n for p, n in by_blocker.items() if n}
    one = locks.lock_classes(c).filter("relation is null")
    expected = [(a["pid"], b["pid"]) for a in rows for b in rows if a["relation"] is None is b["relation"] and not a["granted"] and a["pid"] != b["pid"]]
    assert sorted(values(locks.class_pairs(c, one, hot_rows=2), "blocked_pid", "blocking_pid")) == sorted(expected)


def test_subtree_totals_of_a_forest(spark):
    r = random.Random(6)
    parent = {i: None if i in (1, 40) else r.randrange(max(1, i - 4 if i < 40 else 40), i) for i in range(1, 80)}
    parent.update({200: 201, 201: 202, 202: 200, 203: 201, 204: 203})  # a cycle and what hangs below it
    size = {i: r.randrange(100) if i % 5 else None for i in parent}

    def up(i):
        way = [i]
        while parent[way[-1]] is not None and parent[way[-1]] not in way:
            way.append(parent[way[-1]])
        return way if parent[way[-1]] is None else None

    rows = {x["node"]: x for x in tree_totals(spark.createDataFrame([(i, p, size[i]) for i, p in parent.items()], "node long, parent long, s long")).collect()}
    ways = {i: up(i) for i in parent}
    assert len(rows) == len(parent)
    for i, way in ways.items():
        if way is None:
            assert rows[i]["root"] is None and rows[i]["depth"] is None
            continue
        below = [j for j, w in ways.items() if w and i in w]
        assert (rows[i]["root"], rows[i]["depth"], rows[i]["n_nodes"]) == (way[-1], len(way) - 1, len(below))
        assert (rows[i]["s"] or 0) == sum(size[j] or 0 for j in below)
    assert rows[201]["s"] is None and rows[203]["n_nodes"] is None


def test_a_tree_of_5000_levels_takes_13_rounds(spark):
    trace = []
    nodes = spark.range(1, 5001).selectExpr("id as node", "case when id > 1 then id - 1 end as parent", "1L as s")
    rows = tree_totals(nodes, trace=trace)
    assert len(trace) == 13
    assert rows.filter("depth <> node - 1 or root <> 1 or s <> 5001 - node or n_nodes <> s").count() == 0
    assert rows.count() == 5000


def test_partition_totals_by_hand(spark):
    known = [{"oid": i, "relname": f"t{i}", "total_size": 10 * i, "reltuples": float(i)} for i in (1, 2, 3, 4)]
    links = [{"inhrelid": a, "inhparent": b} for a, b in [(2, 1), (3, 1), (4, 2), (4, 3), (9, 4), (5, 5), (None, 1)]]
    c = small_catalog(spark, pg_class=known, pg_inherits=links)
    assert values(partitions.partition_totals(c), "table_name", "table_parent_name", "root_table_name", "depth", "n_parents", "n_tables", "total_bytes") == [
        ("t1", None, "t1", 0, 0, 5, 100), ("t2", "t1", "t1", 1, 1, 3, 60), ("t4", "t2", "t1", 2, 2, 2, 40),
        ("t3", "t1", "t1", 1, 1, 1, 30), ("9", "t4", "t1", 3, 1, 1, 0),
    ]


def test_memberships_are_those_of_the_paths(spark):
    members = [{"member": 20_000 + a, "roleid": 20_000 + b} for a, b in random_edges(9, 12, 16) if a != b]
    c = small_catalog(spark, pg_auth_members=members, pg_roles=[{"oid": 20_000 + i, "rolname": f"r{i}"} for i in range(12)])
    paths = set(values(access.role_paths(c).filter("member <> role"), "member", "role"))
    assert sorted(values(access.role_memberships(c), "member", "role")) == sorted(paths)


def test_a_recursive_query_walks_as_the_level_loop(spark):
    tree = [{"oid": i, "relname": f"t{i}", "relnamespace": 1, "relkind": "p", "relispartition": i > 1} for i in range(1, 20)]
    links = [{"inhrelid": i, "inhparent": i // 2} for i in range(2, 20)] + [{"inhrelid": 2, "inhparent": 9}]
    c = small_catalog(spark, pg_class=tree, pg_inherits=links)
    columns = "table_name", "table_parent_name", "level"
    whole = values(partitions.partition_tree(c), *columns)
    assert max(w[2] for w in whole) == 4
    for depth in (0, 1, 3, 9):
        assert sorted(values(partitions.partition_tree(c, depth=depth), *columns), key=str) == sorted([w for w in whole if w[2] <= depth], key=str)
    spark.conf.set("spark.sql.cteRecursionRowLimit", 7)
    try:
        with pytest.raises(ValueError, match="cteRecursionRowLimit"):
            partitions.partition_tree(c, depth=9).count()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


@pytest.mark.parametrize("hot_rows", [4096, 3])
def test_containment_against_all_pairs(spark, hot_rows):
    r = random.Random(7)
    make = lambda n, most: [(r.choice([1, 1, 2, None]), i, r.sample([*range(9), None], r.randint(0, most)) + [0] * (i % 3)) for i in range(n)]
    lefts, rights = make(40, 3) + [(1, 90, None), (1, 91, [77])], make(50, 7) + [(1, 92, None)]
    left = spark.createDataFrame(lefts, "k long, left_id long, left_items array<int>")
    right = spark.createDataFrame(rights, "k long, right_id long, right_items array<int>")
    own = lambda s: {x for x in s or () if x is not None}
    expected = [(k, i, j) for k, i, a in lefts for q, j, b in rights if k is not None and k == q and own(a) and b is not None and own(a) <= own(b)]
    found = values(contained_in(left, right, ["k"], hot_rows), "k", "left_id", "right_id")
    assert sorted(found) == sorted(expected) and len(expected) > 100


def test_contained_indexes_by_hand(spark):
    index = lambda i, keys, table=1, **more: {"indexrelid": i, "indrelid": table, "indexname": f"i{i}", "indkey": keys, "amname": "btree", "index_bytes": i, **more}
    rows = [index(1, "1"), index(2, "2 1"), index(3, "1 2"), index(4, "0 1"), index(5, "1 2 3", indpred="x"), index(6, "3"), index(7, "1", 2), index(8, "1", amname="gin")]
    c = small_catalog(spark, pg_index=rows, pg_class=[{"oid": i, "relname": f"t{i}", "relnamespace": 1} for i in (1, 2)])
    assert values(indexes.contained_indexes(c), "index", "contained_in", "same_columns") == [("i3", "i2", True), ("i1", "i2", False), ("i1", "i3", False)]



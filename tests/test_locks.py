"""Lock reports against brute force, cycles and ties included."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import locks
from fleetlens.plans.skew import grid_join
from tests.helpers import lock, sessions, small_catalog, values, waits_for


def chains(edges: set[tuple[int, int]], max_depth: int | None = None) -> set[tuple[int, ...]]:
    """All chains without a repeat that are inside no longer one."""
    below = {}
    for waiter, holder in edges:
        below.setdefault(waiter, []).append(holder)
    found = []

    def grow(path):
        if len(path) > 1:
            found.append(path)
        if max_depth is None or len(path) <= max_depth:
            for nxt in below.get(path[-1], []):
                if nxt not in path:
                    grow((*path, nxt))

    for start in below:
        grow((start,))

    def inside(a, b):
        return any(b[i:i + len(a)] == a for i in range(len(b) - len(a) + 1))

    return {p for p in found if not any(len(q) > len(p) and inside(p, q) for q in found)}


def queue(spark, edges, **args):
    pids = {p for e in edges for p in e}
    c = small_catalog(spark, pg_locks=waits_for(sorted(edges)), pg_stat_activity=sessions(*pids))
    return locks.lock_wait_queue(c, **args)


def graph(seed: int, n: int = 6, p: float = 0.22) -> set[tuple[int, int]]:
    rng = random.Random(seed)
    return {(a, b) for a in range(1, n + 1) for b in range(1, n + 1) if a != b and rng.random() < p}


@pytest.mark.parametrize("seed", range(4))
def test_wait_queue_equals_brute_force(spark, seed):
    edges = graph(seed)
    paths = values(queue(spark, edges), "path")
    assert len(set(paths)) == len(paths)
    assert {tuple(map(int, p.split("->"))) for p in paths} == chains(edges)


@pytest.mark.parametrize("depth", [1, 2])
def test_wait_queue_with_a_depth(spark, depth):
    edges = {(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)}
    paths = values(queue(spark, edges, max_depth=depth), "path")
    assert {tuple(map(int, p.split("->"))) for p in paths} == chains(edges, depth)


def test_deadlock_self_wait_and_diamond(spark):
    assert set(values(queue(spark, {(1, 2), (2, 3), (3, 1)}), "path")) == {"1->2->3", "2->3->1", "3->1->2"}
    assert values(queue(spark, {(1, 1), (1, 2)}), "path") == ["1->2"]
    assert set(values(queue(spark, {(1, 2), (1, 3), (2, 4), (3, 4)}), "path")) == {"1->2->4", "1->3->4"}


def test_containment_compares_whole_pids(spark):
    assert set(values(queue(spark, {(2, 3), (12, 34)}), "path")) == {"2->3", "12->34"}


def test_root_holder_is_that_of_the_shorter_chain(spark):
    row = queue(spark, {(1, 2), (2, 3), (3, 4)}).first()
    assert (row.waiter, row.holder, row.root_holder, row.chain_root, row.deep) == (1, 2, 3, 4, 3)


def test_null_safe_targets(spark):
    bare = {"locktype": "advisory", "mode": "ExclusiveLock"}
    c = small_catalog(spark, pg_locks=[{"pid": 1, "granted": False, **bare}, {"pid": 2, "granted": True, **bare}], pg_stat_activity=sessions(1, 2))
    assert values(locks.lock_pairs(c), "blocked_pid", "blocking_pid") == [(1, 2)]
    assert values(locks.lock_wait_queue(c), "path") == ["1->2"]


def test_two_waiters_block_each_other_unless_granted_is_required(spark):
    c = small_catalog(spark, pg_locks=[lock(1, 9, True), lock(2, 9, False), lock(3, 9, False)], pg_stat_activity=sessions(1, 2, 3))
    assert values(locks.lock_pairs(c), "blocked_pid", "blocking_pid") == [(2, 1), (2, 3), (3, 1), (3, 2)]
    assert values(locks.lock_pairs(c, require_granted=True), "blocked_pid", "blocking_pid") == [(2, 1), (3, 1)]


@pytest.mark.parametrize("hot_rows", [1, 3, 50])
def test_grid_join_forms_every_pair_once(spark, hot_rows):
    rng = random.Random(1)
    left = [(rng.choice(["a", "a", "b", None]), i) for i in range(40)]
    right = [(rng.choice(["a", "a", "c", None]), i) for i in range(40)]
    df = grid_join(
        spark.createDataFrame(left, "k string, l int"), spark.createDataFrame(right, "k string, r int"), ["k"], "l", "r", hot_rows
    )
    expected = Counter((k, x, y) for k, x in left for j, y in right if k == j)
    assert Counter(values(df, "k", "l", "r")) == expected


@pytest.mark.parametrize("depth", [0, 2, None])
def test_report_equals_brute_force(spark, depth):
    """A session known twice, sessions not known, deadlocks, two waits for one session."""
    edges = sorted(graph(11, 6, 0.25) | {(5, 20), (20, 21), (6, 21)}) + [(20, 21)]
    known = sessions(*range(1, 6), 5, 21, 21)
    c = small_catalog(spark, pg_locks=waits_for(edges), pg_stat_activity=known)
    copies = Counter(s["pid"] for s in known)
    paths = [(h,) for h in sorted({h for _, h in edges} - {w for w, _ in edges}) for _ in range(copies[h] or 1)]
    expected, n = Counter(), 0
    while paths and (depth is None or n <= depth):
        for p in paths:
            expected[p] += copies[p[-1]] or 1
        paths, n = [(*p, w) for p in paths for w, h in edges if h == p[-1] and w not in p], n + 1
    rows = locks.lock_report(c, max_depth=depth).collect()
    assert Counter(tuple(r.seq[1:]) for r in rows) == expected
    assert max(r.depth for r in rows) == max(map(len, expected)) - 1
    lost = [r for r in rows if not copies[r.seq[-1]]]
    assert depth == 0 or lost
    assert all(r.lock_info.startswith("Connect:   local\nSQL: N/A\nWaiting: ") and r.state == " started\n\n ago" for r in lost)
    assert all(r.pid.split("=> ")[-1].strip() == str(r.seq[-1]) for r in rows)


def test_a_hot_target_gives_the_same_pairs(spark):
    rows = [lock(p, 1 if p % 3 else p, p % 4 == 0) for p in range(1, 60)]
    c = small_catalog(spark, pg_locks=rows, pg_stat_activity=sessions(*range(1, 60)))
    plain, split = locks.lock_pairs(c), locks.lock_pairs(c, hot_rows=4)
    assert values(plain, "blocked_pid", "blocking_pid") == values(split, "blocked_pid", "blocking_pid")
    assert plain.count() > 100


def test_report_tree(spark):
    c = small_catalog(
        spark,
        pg_class=[{"oid": 9, "relname": "t"}], pg_database=[{"oid": 5, "datname": "d"}],
        pg_locks=[lock(1, 9, True, "AccessShareLock", database=5), lock(2, 9, False, "AccessExclusiveLock", database=5),
                  lock(2, 8, True, "ShareLock", database=5), lock(3, 8, False, "RowExclusiveLock", database=5),
                  lock(4, 9, False, "AccessShareLock", database=5)],
        pg_stat_activity=[{"pid": 1, "usename": "u", "datname": "d", "client_addr": "10.0.0.1/32", "client_port": 5, "query": "a\nb" + "x" * 100,
                           "state": "idle in transaction"}, *sessions(2, 3, wait_event="w")],
    )
    rows = locks.lock_report(c).collect()
    assert [r.pid for r in rows] == ["1", " => 2", "     => 3"]
    assert rows[0].lock_info == (
        "Connect: u d 10.0.0.1:5\nSQL: a b" + "x" * 57 + "\nAcquired:\n  AccessShareLock(relation,db:d;rel:t)")
    assert rows[1].lock_info.splitlines()[2:] == [
        "Waiting: AccessExclusiveLock(relation,db:d;rel:t)", "Acquired:", "  ShareLock(relation,db:d;rel:8)"]
    assert rows[1].state == " started\nwaiting\n ago"


def test_report_stops_at_deadlocks_and_depth(spark):
    ring = waits_for([(1, 2), (2, 1), (1, 9)])
    c = small_catalog(spark, pg_locks=ring, pg_stat_activity=sessions(1, 2, 9))
    assert [r.seq[1:] for r in locks.lock_report(c).collect()] == [[9], [9, 1], [9, 1, 2]]
    line = waits_for([(i, i + 1) for i in range(1, 9)])
    c = small_catalog(spark, pg_locks=line, pg_stat_activity=sessions(*range(1, 10)))
    assert [r.depth for r in locks.lock_report(c).collect()] == [0, 1, 2, 3, 4, 5]


def test_report_shows_five_locks(spark):
    held = [lock(1, r, True) for r in range(1, 9)] + [lock(2, 7, False), lock(3, 7, False)]
    c = small_catalog(spark, pg_locks=held, pg_stat_activity=sessions(1, 2, 3))
    lines = locks.lock_report(c).first().lock_info.splitlines()[3:]
    assert lines == ["  ExclusiveLock(relation,rel:7) + 2", *[f"  ExclusiveLock(relation,rel:{i})" for i in (1, 2, 3, 4)], "  ... 3 more ..."]


def test_report_waiter_of_a_mode_it_does_not_conflict_with(spark):
    c = small_catalog(spark, pg_locks=[lock(1, 9, True, "AccessShareLock"), lock(2, 9, False, "RowShareLock")], pg_stat_activity=sessions(1, 2))
    assert locks.lock_report(c).isEmpty()


def tree_by_hand(edges):
    blockers = {}
    for w, h in edges:
        blockers.setdefault(w, set()).add(h)
    rows = Counter()
    for top in {h for _, h in edges} - set(blockers):
        placed, level = {top}, [(top,)]
        while level:
            for path in level:
                rows[(top, len(path), path[-1])] += 1
            ready = {w for w, b in blockers.items() if w not in placed and b <= placed}
            level = [(*p, w) for p in level for w in ready if p[-1] in blockers[w]]
            placed |= ready
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_tree_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a in range(2, 12) for b in range(1, a) if rng.random() < 0.25} | ({(20, 21), (21, 20)} if seed else set())
    pids = {p for e in edges for p in e}
    c = small_catalog(spark, pg_locks=waits_for(sorted(edges)), pg_stat_activity=sessions(*pids))
    assert Counter(values(locks.lock_tree(c), "top_blocker_pid", "level", "pid")) == tree_by_hand(edges)


def test_tree_of_a_diamond(spark):
    edges = [(2, 1), (3, 1), (4, 2), (4, 3)]
    c = small_catalog(spark, pg_locks=waits_for(edges), pg_stat_activity=sessions(1, 2, 3, 4, state="idle in transaction"))
    rows = values(locks.lock_tree(c), "pid", "level", "blkd", "blocked_by", "statement", "state")
    assert rows == [
        (1, 1, 3, [], "    [1] q1", "idletx"), (2, 2, 1, [1], "    [2] . q2", "idletx"), (3, 2, 1, [1], "    [3] . q3", "idletx"),
        (4, 3, 0, [2, 3], "    [4] .. q4", "idletx"), (4, 3, 0, [2, 3], "    [4] .. q4", "idletx"),
    ]


def test_reports_of_no_locks_are_empty(spark):
    c = small_catalog(spark)
    for report in (locks.lock_pairs, locks.lock_report, locks.lock_wait_queue, locks.lock_tree):
        assert report(c).filter(F.lit(True)).isEmpty()

"""Who waits for whom."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.numbers import spread_absent, to_whole
from fleetlens.functions.order import down, up
from fleetlens.functions.text import concat_skip_null, span_text
from fleetlens.functions.times import exact_seconds_between, seconds_between
from fleetlens.plans.graphs import strong_components
from fleetlens.plans.levels import cut_lineage, drop_rows, keep_rows, stow_rows, union_all, walk_levels
from fleetlens.plans.skew import HOT_ROWS, grid_join
from fleetlens.sources.catalog import Catalog
from fleetlens.sources.lock_modes import lock_conflicts

# The columns that together name what is locked.
TARGET = [
    "locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid",
    "objid", "objsubid",
]


def _blocking(c: Catalog, require_granted: bool, hot_rows: int) -> DataFrame:
    """(keys, blocked_pid, blocking_pid) per pair of locks on one target."""
    locks = c.table("pg_locks").filter(F.col("locktype").isNotNull())
    blocked = locks.filter(~F.col("granted")).select(*c.on(*TARGET), F.col("pid").alias("blocked_pid"))
    blocking = locks.filter("granted") if require_granted else locks
    blocking = blocking.select(*c.on(*TARGET), F.col("pid").alias("blocking_pid"))
    return (
        grid_join(blocked, blocking, c.on(*TARGET), "blocked_pid", "blocking_pid", hot_rows)
        .filter(F.col("blocked_pid") != F.col("blocking_pid"))
        .select(*c.on("blocked_pid", "blocking_pid"))
    )


def lock_pairs(c: Catalog, require_granted: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Waiting sessions with the other sessions at the same lock target.

    The other side need not hold the lock unless ``require_granted``: two
    sessions waiting for the same target then name each other. Statements are
    joined to the finished pairs.
    """

    def session(side: str) -> DataFrame:
        return c.table("pg_stat_activity").select(
            *c.keys,
            F.col("pid").alias(f"{side}_pid"),
            F.col("usename").alias(f"{side}_user"),
            seconds_between(F.col("query_start"), c.now).alias(f"{side}_duration"),
            F.col("query").alias(f"{side}_statement"),
        )

    df = (
        _blocking(c, require_granted, hot_rows)
        .join(session("blocked"), c.on("blocked_pid"), "inner")
        .join(session("blocking"), c.on("blocking_pid"), "inner")
        .select(
            *c.on("blocked_pid", "blocked_user", "blocked_duration"),
            "blocking_pid", "blocking_user", "blocking_duration",
            "blocked_statement", "blocking_statement",
        )
    )
    return c.sort(df, up("blocked_pid"), up("blocking_pid"))


# ---------------------------------------------------------------- wait queue


def _a_few(edges: DataFrame, keys: list[str], by: str, other: str, n: int) -> DataFrame:
    """Up to ``n`` of the ``other`` ends of the edges at each ``by`` end.

    The rank filter runs in each task before the shuffle, so a hot end sends
    ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys, by).orderBy(other))
    return (
        edges.withColumn("rank", rank)
        .filter(F.col("rank") <= n)
        .groupBy(*keys, by)
        .agg(F.collect_list(other).alias("others"))
    )


def _with_extension(level: DataFrame, edges: DataFrame, c: Catalog, depth: int, at_head: bool) -> DataFrame:
    """Add ``extends``: whether a session outside the path continues it there.

    A path of this level has depth + 1 sessions, one of them the end itself. If
    more than ``depth`` sessions adjoin the end, one is outside the path, so
    depth + 1 of them settle the question.
    """
    by, other = ("holder", "waiter") if at_head else ("waiter", "holder")
    end = F.get("path", F.lit(0)) if at_head else F.element_at("path", -1)
    near = _a_few(edges, c.keys, by, other, depth + 1).withColumnRenamed(by, "end")
    return (
        level.withColumn("end", end)
        .join(near, c.on("end"), "left")
        .withColumn(
            "extends",
            F.coalesce(
                F.exists("others", lambda x: ~F.array_contains(F.col("path"), x)), F.lit(False)
            ),
        )
        .drop("end", "others")
    )


def _cyclic_core(edges: DataFrame, c: Catalog) -> tuple[DataFrame, bool]:
    """The edges from which waiting never ends: those that lead into a cycle.

    Edges to a holder that waits for no one are taken off, round by round.
    """
    core, size = edges, -1
    while True:
        waiters = core.select(*c.keys, F.col("waiter").alias("holder")).distinct()
        core = cut_lineage(core.join(waiters, c.on("holder"), "left_semi"))
        left = core.count()
        if left in (0, size):
            return core, left > 0
        size = left


def _wait_edges(c: Catalog, hot_rows: int) -> DataFrame:
    """(keys, waiter, holder) of sessions at one lock target, each pair once."""
    locks = c.table("pg_locks")
    waiting = locks.filter(~F.col("granted")).select(*c.on(*TARGET), F.col("pid").alias("waiter"))
    holding = (
        locks.filter("granted")
        .select(*c.on(*TARGET), "pid")
        .join(c.table("pg_stat_activity").select(*c.on("pid")), c.on("pid"), "left_semi")
        .select(*c.on(*TARGET), F.col("pid").alias("holder"))
    )
    return cut_lineage(
        grid_join(waiting, holding, c.on(*TARGET), "waiter", "holder", hot_rows)
        .select(*c.on("waiter", "holder"))
        .filter(F.col("waiter") != F.col("holder"))
        .distinct()
    )


def lock_wait_queue(
    c: Catalog, max_depth: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Chains of waiting sessions, ``waiter->holder->…``, the longest ones only.

    Chains are grown from their last holder towards the waiters. A chain is
    reported if it is part of no longer one, which is so if no session outside
    it waits for its first, and its last waits for no session outside it: two
    lookups instead of comparing all chains with each other. No session is
    twice in a chain, so the walk ends at deadlocks.

    ``root_holder`` is the holder of the chain one step shorter; ``chain_root``
    is the real end of the chain. With ``max_depth`` longer chains are reported
    as the pieces of that depth.
    """
    edges = _wait_edges(c, hot_rows)
    core, has_cycles = _cyclic_core(edges, c)
    also_waiting = edges.select(*c.keys, F.col("waiter").alias("holder")).distinct()
    last_steps = edges.join(also_waiting, c.on("holder"), "left_anti")
    if has_cycles:
        last_steps = last_steps.unionByName(core)
    if max_depth is not None:
        # A cut chain can end anywhere.
        last_steps = edges
    seed = last_steps.select(*c.keys, F.array("waiter", "holder").alias("path"))
    longer = edges.select(*c.keys, F.col("holder").alias("first"), F.col("waiter").alias("next"))

    def step(level: DataFrame, depth: int) -> DataFrame:
        return (
            level.withColumn("first", F.get("path", F.lit(0)))
            .join(longer, c.on("first"), "inner")
            .filter(~F.array_contains("path", F.col("next")))
            .select(*c.keys, F.concat(F.array("next"), "path").alias("path"))
        )

    levels = walk_levels(seed, step, max_depth)
    kept = []
    for depth, level in enumerate(levels, 1):
        if depth == max_depth:
            kept.append(level)
            continue
        chains = _with_extension(level, edges, c, depth, at_head=True).filter(~F.col("extends"))
        if has_cycles or max_depth is not None:
            chains = _with_extension(
                chains.drop("extends"), edges, c, depth, at_head=False
            ).filter(~F.col("extends"))
        kept.append(chains.drop("extends"))
    path = F.col("path")
    df = union_all(kept).select(
        *c.keys,
        F.get(path, F.lit(0)).alias("waiter"),
        F.get(path, F.lit(1)).alias("holder"),
        F.coalesce(F.get(path, F.lit(2)), F.get(path, F.lit(1))).alias("root_holder"),
        F.array_join(path.cast("array<string>"), "->").alias("path"),
        (F.size(path) - 1).alias("deep"),
        F.element_at(path, -1).alias("chain_root"),
    )
    return c.sort(df, up("root_holder"), up("path"))


# ---------------------------------------------------------------- deadlocks


def deadlocks(c: Catalog, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Who waits for whom inside each deadlock, one row per wait.

    A deadlock is a set of sessions that all wait for each other, directly or through
    others: a strong component of the waits, named after its smallest pid. Sessions
    that only wait for a deadlock, or for one of several from another, are in none.
    Statements and users are joined to the finished rows.
    """
    edges = _wait_edges(c, hot_rows)
    parts = cut_lineage(
        strong_components(edges.select(*c.keys, F.col("waiter").alias("a"), F.col("holder").alias("b")), c.keys)
    )
    sizes = parts.groupBy(*c.on("component")).agg(F.count("*").alias("sessions"))
    inside = (
        edges.join(parts.withColumnRenamed("node", "waiter"), c.on("waiter"))
        .join(parts.withColumnsRenamed({"node": "holder", "component": "other"}), c.on("holder"))
        .filter("component = other")
        .join(sizes, c.on("component"))
    )
    session = c.table("pg_stat_activity").select(
        *c.keys, F.col("pid").alias("waiter"), F.col("usename").alias("waiter_user"),
        seconds_between(F.col("query_start"), c.now).alias("waiter_duration"), F.col("query").alias("waiter_statement"),
    )
    df = inside.join(session, c.on("waiter"), "left").select(
        *c.keys, F.col("component").alias("deadlock"), "sessions", "waiter", "holder", "waiter_user", "waiter_duration",
        "waiter_statement",
    )
    return c.sort(df, up("deadlock"), up("waiter"), up("holder"))


# ------------------------------------------------------------- lock classes


def _at_targets(c: Catalog, require_granted: bool) -> DataFrame:
    """(keys, target columns, pid, waits, blocks): what each session has at each lock
    target, how often it waits there and how often it stands in the way of others."""
    known = c.table("pg_stat_activity").select(*c.on("pid")).distinct()
    waits = F.count_if(~F.col("granted"))
    blocks = F.count_if(F.col("granted")) if require_granted else F.count(F.lit(1))
    return (
        c.table("pg_locks").filter(F.col("locktype").isNotNull())
        .groupBy(*c.on(*TARGET, "pid")).agg(waits.alias("waits"), blocks.alias("blocks"))
        .join(known, c.on("pid"), "left_semi")
    )


def lock_classes(c: Catalog, require_granted: bool = False) -> DataFrame:
    """R17 without its pairs: per lock target the class of those who wait and the class
    of those in their way, and the number of pairs the two make.

    A pair of R17 is a waiter and another session of one target, so pairs per target
    are the product of the classes less what a session would pair with itself. Work and
    result are linear in the locks, where the pairs grow with the square of a busy target.
    :func:`class_pairs` expands the targets asked for. Sessions unknown to the activity view
    are left out, as in the pairs.
    """
    own = F.col("waits") * F.col("blocks")
    df = (
        _at_targets(c, require_granted).groupBy(*c.on(*TARGET))
        .agg(
            F.sum("waits").alias("n_waits"), F.count_if(F.col("waits") > 0).alias("n_waiters"), F.sum("blocks").alias("n_blocks"),
            F.count_if(F.col("blocks") > 0).alias("n_blockers"), F.sum(own).alias("own"),
        )
        .filter("n_waits > 0")
        .withColumn("n_pairs", F.col("n_waits") * F.col("n_blocks") - F.col("own")).drop("own")
    )
    return c.sort(df, down("n_pairs"), *[up(t) for t in TARGET])


def _same_target(targets: DataFrame, on: list[str], *carried: str) -> tuple[DataFrame, Column]:
    """Distinct targets under other names, and the condition that a row is at one of them."""
    other = targets.select(*[F.col(x).alias(f"at_{x}") for x in on], *carried).distinct()
    return other, reduce(and_, [F.col(x).eqNullSafe(F.col(f"at_{x}")) for x in on])


def class_pairs(c: Catalog, targets: DataFrame, require_granted: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, blocked_pid, blocking_pid) of the given rows of :func:`lock_classes`, as often as R17 has each."""
    on = c.on(*TARGET)
    # Both sides are counted and then joined: kept once instead of found four times.
    here = keep_rows(_at_targets(c, require_granted).join(*_same_target(targets, on), "left_semi"))
    blocked = here.filter("waits > 0").select(*on, F.col("pid").alias("blocked_pid"), F.col("waits").alias("m"))
    blocking = here.filter("blocks > 0").select(*on, F.col("pid").alias("blocking_pid"), F.col("blocks").alias("n"))
    pairs = grid_join(blocked, blocking, on, "blocked_pid", "blocking_pid", hot_rows).filter("blocked_pid <> blocking_pid")
    times = F.explode(F.sequence(F.lit(1), F.col("m") * F.col("n")))
    return pairs.select(*c.on("blocked_pid", "blocking_pid"), times.alias("time")).drop("time")


def top_blockers(c: Catalog, require_granted: bool = False) -> DataFrame:
    """Sessions by the number of R17's pairs they block and wait in, from the classes alone."""
    here = _at_targets(c, require_granted)
    on = c.on(*TARGET)
    total = here.groupBy(*on).agg(F.sum("waits").alias("all_waits"), F.sum("blocks").alias("all_blocks"))
    df = (
        here.join(*_same_target(total, on, "all_waits", "all_blocks"))
        .select(
            *c.on("pid"),
            (F.col("blocks") * (F.col("all_waits") - F.col("waits"))).alias("blocks"),
            (F.col("waits") * (F.col("all_blocks") - F.col("blocks"))).alias("waits"),
        )
        .groupBy(*c.on("pid")).agg(F.sum("blocks").alias("n_blocked"), F.sum("waits").alias("n_waiting_for"))
        .filter("n_blocked > 0 or n_waiting_for > 0")
        .join(c.pick("pg_stat_activity", pid="pid", usename="usename", state="state"), c.on("pid"), "left")
        .select(*c.on("pid", "usename", "state", "n_blocked", "n_waiting_for"))
    )
    return c.sort(df, down("n_blocked"), up("pid"))


# --------------------------------------------------------------- lock report

#: Held locks of a session that are written out; the rest is a number.
LOCKS_SHOWN = 5
#: Levels below a root blocker.
REPORT_DEPTH = 5


# The columns that name the target of each kind of lock in the
# report; a kind not listed is named by its database alone.
NAMED_BY = {
    "database": ["relation", "extend", "page", "tuple"],
    "relation": ["relation", "extend", "page", "tuple"],
    "page": ["page", "tuple"],
    "tuple": ["tuple"],
    "transactionid": ["transactionid"],
    "virtualxid": ["virtualxid"],
    "classid": ["object"],
    "objid": ["object"],
    "objsubid": ["object"],
}
REPORT_TARGET = ["locktype", *NAMED_BY]


def _report_locks(c: Catalog) -> DataFrame:
    """Locks with the target columns that their kind does not use set to NULL."""
    kind = F.col("locktype")
    listed = sorted({k for kinds in NAMED_BY.values() for k in kinds})
    columns = []
    for name, kinds in NAMED_BY.items():
        used = kind.isin(*kinds)
        if name == "database":
            used = used | ~kind.isin(*listed)
        columns.append(F.when(used, F.col(name)).alias(name))
    return c.table("pg_locks").select(*c.on("pid", "granted", "mode", "locktype"), *columns)


def _with_target_text(c: Catalog, locks: DataFrame) -> DataFrame:
    """Add ``lock_target``: mode and target as text, ``ShareLock(relation,db:a;rel:b)``."""
    named = (
        locks.withColumns(
            {
                "relation_key": spread_absent(F.col("relation"), F.col("pid")),
                "class_key": spread_absent(F.col("classid"), F.col("pid")),
                "database_key": spread_absent(F.col("database"), F.col("pid")),
            }
        )
        .join(c.pick("pg_database", database_key="oid", datname="datname"), c.on("database_key"), "left")
        .join(c.pick("pg_class", relation_key="oid", relation_name="relname"), c.on("relation_key"), "left")
        .join(c.pick("pg_class", class_key="oid", class_name="relname"), c.on("class_key"), "left")
    )

    def part(label: str, *value: str) -> Column:
        return F.concat(F.lit(label), F.coalesce(*[F.col(v).cast("string") for v in value]))

    # Parts a kind does not use are NULL and vanish.
    object_name = F.concat_ws(
        ";",
        part("db:", "datname"),
        part("rel:", "relation_name", "relation"),
        part("page#", "page"),
        part("tuple#", "tuple"),
        part("class:", "class_name", "classid"),
        part("objid:", "objid"),
        part("col#", "objsubid"),
    )
    kind = F.col("locktype")
    what = (
        F.when(kind == "transactionid", F.col("transactionid").cast("string"))
        .when(kind == "virtualxid", F.col("virtualxid"))
        .otherwise(object_name)
    )
    text = concat_skip_null(F.col("mode"), "(", kind, ",", what, ")")
    return named.withColumn("lock_target", text)


def _waits(c: Catalog, locks: DataFrame, hot_rows: int) -> DataFrame:
    """(keys, pid, blocker_pid, lock_target): waiters with holders in conflict.

    Pairs are formed and judged on the narrow columns; names come after.
    """
    waiting = locks.filter(~F.col("granted")).drop("granted")
    holding = locks.filter("granted").select(
        *c.on(*REPORT_TARGET), F.col("mode").alias("held"), F.col("pid").alias("blocker_pid")
    )
    conflicts = F.broadcast(lock_conflicts(locks.sparkSession))
    pairs = (
        grid_join(waiting, holding, c.on(*REPORT_TARGET), "pid", "blocker_pid", hot_rows)
        .filter(F.col("pid") != F.col("blocker_pid"))
        .withColumn("requested", F.col("mode"))
        .join(conflicts, ["requested", "held"], "inner")
    )
    return _with_target_text(c, pairs).select(*c.on("pid", "blocker_pid", "lock_target"))


def _acquired(c: Catalog, locks: DataFrame, waits: DataFrame, limit: int) -> DataFrame:
    """(keys, pid, acquired): the held locks of the sessions involved, as text.

    Locks with the most waiters come first. Only the locks that are shown are
    collected; the others are counted.
    """
    involved = waits.select(*c.on("pid")).unionByName(
        waits.select(*c.keys, F.col("blocker_pid").alias("pid"))
    ).distinct()
    wait_counts = waits.groupBy(*c.on("lock_target")).agg(F.count(F.lit(1)).alias("wait_count"))
    own = locks.filter("granted").join(involved, c.on("pid"), "left_semi")
    held = (
        _with_target_text(c, own)
        .select(*c.on("pid", "lock_target"))
        .join(wait_counts, c.on("lock_target"), "left")
        .withColumn(
            "entry",
            concat_skip_null(
                F.col("lock_target"), F.concat(F.lit(" + "), F.col("wait_count").cast("string"))
            ),
        )
    )
    order = Window.partitionBy(*c.on("pid")).orderBy(F.col("wait_count").desc_nulls_last(), "entry")
    shown = (
        held.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .groupBy(*c.on("pid"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "entry"))).alias("first"))
    )
    sizes = own.groupBy(*c.on("pid")).agg(F.count(F.lit(1)).alias("n"))
    more = F.when(
        F.col("n") > limit,
        F.concat(F.lit("... "), (F.col("n") - limit).cast("string"), F.lit(" more ...")),
    )
    entries = F.concat(F.transform("first", lambda x: x["entry"]), F.array(more))
    return shown.join(sizes, c.on("pid"), "inner").select(
        *c.on("pid"), F.array_join(entries, "\n  ").alias("acquired")
    )


#: What the report says of a session that the activity view does not have.
UNKNOWN = {"about": "Connect:   local\nSQL: N/A", "state_text": " started\n\n ago"}


def _session_texts(c: Catalog, locks: DataFrame, waits: DataFrame, shown: int) -> DataFrame:
    """(keys, pid, about, acquired, state_text): what the report says of a session wherever it stands."""
    involved = waits.select(*c.on("pid")).unionByName(waits.select(*c.keys, F.col("blocker_pid").alias("pid"))).distinct()
    sessions = c.table("pg_stat_activity").select(
        *c.on("pid", "usename", "datname", "client_addr", "client_port", "query", "query_start", "wait_event", "state")
    )
    address = F.concat(
        F.get(F.split("client_addr", "/"), F.lit(0)), F.lit(":"), F.col("client_port").cast("string")
    )
    about = concat_skip_null(
        "Connect: ", F.col("usename"), " ", F.col("datname"), " ", F.coalesce(address, F.lit("local")),
        "\nSQL: ",
        F.replace(F.substring(F.coalesce("query", F.lit("N/A")), 1, 60), F.lit("\n"), F.lit(" ")),
    )
    # The age that chooses the format counts from the start of the day.
    long_ago = exact_seconds_between(F.col("query_start"), F.date_trunc("day", c.now)) > 86400
    day = F.concat(
        F.rpad(F.date_format("query_start", "EEEE"), 9, " "), F.date_format("query_start", " dd MMM")
    )
    state = concat_skip_null(
        F.when(long_ago, day).otherwise(F.date_format("query_start", "HH:mm:ss")),
        " started\n",
        F.when(F.col("wait_event").isNotNull(), "waiting").otherwise(F.col("state")),
        "\n",
        span_text(seconds_between(F.col("query_start"), c.now)),
        " ago",
    )
    acquired = stow_rows(_acquired(c, locks, waits, shown))
    texts = stow_rows(
        involved.join(acquired, c.on("pid"), "left")
        .join(sessions, c.on("pid"), "left")
        .select(*c.on("pid"), about.alias("about"), "acquired", state.alias("state_text"))
    )
    drop_rows(acquired)
    return texts


def lock_report(
    c: Catalog, max_depth: int | None = REPORT_DEPTH, hot_rows: int = HOT_ROWS, shown: int = LOCKS_SHOWN
) -> DataFrame:
    """Blocked sessions as indented trees under the sessions that block them.

    ``seq`` sorts a tree in reading order: start of the root's statement, then
    the pids from the root down. A session that is already above in its own
    branch (a deadlock) does not open another level. ``max_depth=None`` follows
    every branch to its end; ``shown`` held locks are spelled out, the rest counted.

    Trees have far more rows than there are sessions: what is said of a session is made once for
    each, and a row of a tree is no more than its lock and ``seq``, which ends with its own pid.
    """
    locks = _report_locks(c)
    waits = stow_rows(_waits(c, locks, hot_rows))
    texts = _session_texts(c, locks, waits, shown)
    waiting_pids = waits.select(*c.on("pid")).distinct()
    started = c.table("pg_stat_activity").select(
        *c.on("pid"), to_whole(F.unix_micros("query_start") / F.lit(1e6)).alias("started")
    )
    seed = (
        waits.select(*c.keys, F.col("blocker_pid").alias("pid"))
        .distinct()
        .join(waiting_pids, c.on("pid"), "left_anti")
        .join(started, c.on("pid"), "left")
        .select(*c.keys, F.lit(None).cast("string").alias("lock_target"), F.array("started", "pid").alias("seq"))
    )
    below = waits.select(*c.keys, F.col("blocker_pid").alias("above"), F.col("pid").alias("next"), "lock_target")

    def step(level: DataFrame, depth: int) -> DataFrame:
        branch = F.slice("seq", 2, depth)
        return (
            level.select(*c.keys, F.element_at("seq", -1).alias("above"), "seq")
            .join(below, c.on("above"), "inner")
            .filter(~F.array_contains(branch, F.col("next")))
            .select(*c.keys, "lock_target", F.array_append("seq", F.col("next")).alias("seq"))
        )

    tree = union_all(walk_levels(seed, step, None if max_depth is None else max_depth + 1, stow_rows))
    drop_rows(waits)
    depth = F.size("seq") - 2
    info = concat_skip_null(
        F.coalesce("about", F.lit(UNKNOWN["about"])),
        F.concat(F.lit("\nWaiting: "), F.col("lock_target")),
        F.concat(F.lit("\nAcquired:\n  "), F.col("acquired")),
    )
    of = texts.withColumnsRenamed({k: f"of_{k}" for k in c.keys})
    # The pid is taken from ``seq`` on both sides of the shuffle, not sent along.
    own = F.element_at("seq", -1)
    same = reduce(and_, [tree[k] == of[f"of_{k}"] for k in c.keys], own == of["pid"])
    df = tree.join(of, same, "left").select(
        *c.keys,
        concat_skip_null(F.lpad(F.lit("=> "), 4 * depth, F.lit(" ")), own).alias("pid"),
        info.alias("lock_info"),
        F.coalesce("state_text", F.lit(UNKNOWN["state_text"])).alias("state"),
        depth.alias("depth"),
        "seq",
    )
    return c.sort(df, up("seq"))


# ----------------------------------------------------------------- lock tree


def lock_tree(c: Catalog, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sessions below each top blocker, with ages and the number they block.

    A session takes its place once all its blockers have theirs, under those of
    the level just above. Idle sessions take no part. ``blocked_by`` lists the
    blockers of one session, which a server's connection limit bounds.
    """
    active = c.table("pg_stat_activity").filter(~F.col("state").eqNullSafe(F.lit("idle")))
    edges = cut_lineage(
        _blocking(c, True, hot_rows)
        .distinct()
        .join(active.select(*c.keys, F.col("pid").alias("blocked_pid")), c.on("blocked_pid"), "left_semi")
    )
    needed = edges.groupBy(*c.on("blocked_pid")).agg(F.count(F.lit(1)).alias("n_needed"))
    seed = (
        edges.select(*c.keys, F.col("blocking_pid").alias("pid"))
        .distinct()
        .join(active.select(*c.on("pid")), c.on("pid"), "left_semi")
        .join(edges.select(*c.keys, F.col("blocked_pid").alias("pid")), c.on("pid"), "left_anti")
        .select(*c.keys, F.col("pid").alias("top_blocker_pid"), "pid", F.array("pid").alias("path"))
    )
    group = c.on("top_blocker_pid", "blocked_pid")
    seen: DataFrame | None = None

    def step(level: DataFrame, depth: int) -> DataFrame:
        nonlocal seen
        members = level.select(*c.keys, "top_blocker_pid", F.col("pid").alias("blocking_pid")).distinct()
        placed = members.join(edges, c.on("blocking_pid"), "inner").select(*group, F.lit(1).alias("n"))
        if seen is not None:
            placed = placed.unionByName(seen)
        counts = placed.groupBy(*group).agg(F.sum("n").alias("n"))
        counts = cut_lineage(counts.join(needed, c.on("blocked_pid"), "inner"))
        seen = counts.filter(F.col("n") < F.col("n_needed")).select(*group, "n")
        ready = counts.filter(F.col("n") == F.col("n_needed")).select(*group)
        return (
            level.select(*c.keys, "top_blocker_pid", F.col("pid").alias("blocking_pid"), "path")
            .join(edges, c.on("blocking_pid"), "inner")
            .join(ready, group, "left_semi")
            .select(
                *c.on("top_blocker_pid"),
                F.col("blocked_pid").alias("pid"),
                F.array_append("path", F.col("blocked_pid")).alias("path"),
            )
        )

    tree = union_all(walk_levels(seed, step))
    blocks = (
        tree.select(*c.keys, "pid", F.explode("path").alias("above"))
        .filter(F.col("pid") != F.col("above"))
        .groupBy(*[F.col(k) for k in c.keys], F.col("above").alias("pid"))
        .agg(F.countDistinct("pid").alias("blkd"))
    )
    blockers = edges.groupBy(*[F.col(k) for k in c.keys], F.col("blocked_pid").alias("pid")).agg(
        F.sort_array(F.collect_list("blocking_pid")).alias("blocked_by")
    )
    level = F.size("path")
    label = F.lpad(F.concat(F.lit("["), F.col("pid").cast("string"), F.lit("]")), 7, " ")
    dots = F.when(level > 1, F.concat(F.repeat(F.lit("."), level - 1), F.lit(" "))).otherwise("")
    df = (
        tree.join(active, c.on("pid"), "inner")
        .join(blockers, c.on("pid"), "left")
        .join(blocks, c.on("pid"), "left")
        .select(
            *c.on("pid"),
            F.coalesce("blocked_by", F.array().cast("array<bigint>")).alias("blocked_by"),
            seconds_between(F.col("xact_start"), c.now).alias("tx_age"),
            seconds_between(F.col("state_change"), c.now).alias("state_age"),
            F.replace("state", F.lit("idle in transaction"), F.lit("idletx")).alias("state"),
            "datname",
            "usename",
            F.concat(
                F.coalesce("wait_event_type", F.lit("")), F.lit(":"), F.coalesce("wait_event", F.lit(""))
            ).alias("wait"),
            F.coalesce("blkd", F.lit(0)).alias("blkd"),
            F.concat(label, F.lit(" "), dots, F.coalesce("query", F.lit(""))).alias("statement"),
            level.alias("level"),
            "top_blocker_pid",
        )
    )
    return c.sort(df, up("top_blocker_pid"), up("level"), up("pid"))

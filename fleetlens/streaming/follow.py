"""Following each running command over all its polls, with state that no window ends.

A session's state lives from its first poll until it has not been seen for a
while. Polls wait in the state until the watermark has passed them and are then
taken in the order of their times, so the result does not depend on how the
polls were cut into files or batches: it is the one that window functions give
over all polls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.numbers import ratio
from fleetlens.streaming.progress import COUNTERS

_RESULT = "at bigint, kind string, phase string, done bigint, total bigint, polls bigint, rate double, stalled_for double"


def _micros(interval: str) -> int:
    """Length of a day-time interval such as ``90 seconds``."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    number, unit = interval.split()
    return int(float(number) * units[unit.removesuffix("s")] * 1_000_000)


def follow_progress(
    polls: DataFrame,
    view: str = "pg_stat_progress_vacuum",
    keys: Sequence[str] = ("cluster_id",),
    time: str = "snapshot_ts",
    last: int = 5,
    stall_after: str = "10 minutes",
    expire_after: str = "1 hour",
    delay: str = "10 minutes",
    until: Column | None = None,
) -> DataFrame:
    """Every poll of every running command with what the polls before it tell.

    Rows are ``(keys, pid, seen_at, kind, phase, done, total, polls, rate, stalled_for)``. ``kind`` is

    - ``progress``: a poll. ``rate`` is the work done per second over the last ``last`` polls,
      ``stalled_for`` the seconds since phase or counter last changed, ``polls`` the number so far.
    - ``stalled``: the first poll of a standstill at which it has lasted ``stall_after``.
    - ``gone``: no poll for ``expire_after`` since the last one; ``seen_at`` is when that was
      known, the other columns are those of the last poll. A session that shows up again
      later starts anew.

    A poll delivered twice, or twice with different values, counts once: the one of
    the largest counters. On a stream, rows appear when the watermark, ``delay`` behind the
    newest poll, has passed them, and polls older than that are dropped. State per
    session is the last ``last`` polls and those the watermark has not reached. On a
    batch, polls up to ``until`` give the same rows; without it, all polls do and every last one
    is followed by its ``gone``.
    """
    done, total = COUNTERS[view]
    rows = polls.select(
        *keys, "pid", F.col(time).cast("timestamp").alias("seen_at"), F.col("phase").cast("string"),
        F.col(done).cast("long").alias("done"), F.col(total).cast("long").alias("total"),
    ).filter(F.col("seen_at").isNotNull())
    limits = (last, _micros(stall_after), _micros(expire_after))
    found = _stateful(rows, keys, delay, *limits) if polls.isStreaming else _windowed(rows, keys, until, *limits)
    return found.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "seen_at")


def _windowed(rows: DataFrame, keys: Sequence[str], until: Column | None, last: int, stall: int, expire: int) -> DataFrame:
    session = [*keys, "pid"]
    if until is not None:
        rows = rows.filter(F.col("seen_at") <= until)
    once = (
        rows.withColumn("at", F.unix_micros("seen_at")).groupBy(*session, "at")
        .agg(F.max(F.struct("done", "total", "phase")).alias("poll")).select(*session, "at", "poll.*")
    )
    by_time = Window.partitionBy(*session).orderBy("at")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(by_time) > expire, F.lit(True))
    runs = once.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_time))
    run = Window.partitionBy(*session, "run").orderBy("at")
    recent = run.rowsBetween(1 - last, Window.currentRow)
    same = F.lag("done").over(run).eqNullSafe(F.col("done")) & F.lag("phase").over(run).eqNullSafe(F.col("phase"))
    changed = F.when(~(same & (F.col("fresh") == 0)), F.col("at"))
    told = (
        runs.withColumn("changed", changed)
        .withColumns({
            "since": F.max("changed").over(run),
            "polls": F.row_number().over(run).cast("long"),
            "rate": ratio(F.col("done") - F.first("done").over(recent), (F.col("at") - F.first("at").over(recent)) / 1e6),
            "next": F.lead("at").over(run),
        })
        .withColumn("stalled", F.col("at") - F.col("since"))
    )
    before = F.lag("stalled").over(Window.partitionBy(*session, "run", "since").orderBy("at"))
    alarm = (F.col("stalled") >= stall) & (F.coalesce(before, F.lit(-1)) < stall)
    told = told.withColumn("kind", F.when(alarm, "stalled").otherwise("progress"))
    columns = [*session, "at", "kind", "phase", "done", "total", "polls", "rate", (F.col("stalled") / 1e6).alias("stalled_for")]
    over = F.lit(True) if until is None else F.col("at") + expire <= F.unix_micros(until)
    gone = told.filter(F.col("next").isNull() & over).withColumns({"at": F.col("at") + expire, "kind": F.lit("gone")})
    return told.select(*columns).unionByName(gone.select(*columns))


def _stateful(rows: DataFrame, keys: Sequence[str], delay: str, last: int, stall: int, expire: int) -> DataFrame:
    result = T.StructType([*(rows.schema[k] for k in (*keys, "pid")), *T.StructType.fromDDL(_RESULT)])
    # Counters travel as text: pandas has no whole numbers beside nulls.
    rows = rows.withWatermark("seen_at", delay).withColumns({
        "at": F.unix_micros("seen_at"), "done": F.col("done").cast("string"), "total": F.col("total").cast("string"),
    })
    return rows.groupBy(*keys, "pid").applyInPandasWithState(
        _follower(result.names, last, stall, expire), result, "state string", "append", "EventTimeTimeout"
    )


def _follower(names: list[str], last: int, stall: int, expire: int) -> Callable[..., Iterator]:
    """Defined inside a function, so that it is sent to the executors as a value.

    A session's state is one text: the polls that wait, the recent ones, and what is known.
    Any store of state keeps it, and a call reads and writes it once.
    """

    def order(poll: list) -> tuple:
        at, phase, done, total = poll
        return at, *((x is not None, x if x is not None else empty) for x, empty in ((done, 0), (total, 0), (phase, "")))

    def rate(recent: list[list]) -> float | None:
        (start, first), (end, now) = recent[0], recent[-1]
        return None if start == end or first is None or now is None else (now - first) / ((end - start) / 1e6)

    def row(s: dict, at: int, kind: str) -> tuple:
        return at, kind, s["phase"], s["done"], s["total"], s["polls"], s["rate"], (s["at"] - s["since"]) / 1e6

    def told(s: dict | None, recent: list[list], due: list[list], passed: int, out: list[tuple]) -> tuple[dict | None, list]:
        for at, phase, done, total in due:
            if s and at - s["at"] > expire:
                out.append(row(s, s["at"] + expire, "gone"))
                s = None
            if s is None:
                s, recent = {"polls": 0, "since": at, "alarmed": False}, []
            elif (s["done"], s["phase"]) != (done, phase):
                s |= {"since": at, "alarmed": False}
            recent = [*recent, [at, done]][-last:]
            s |= {"at": at, "phase": phase, "done": done, "total": total, "polls": s["polls"] + 1, "rate": rate(recent)}
            alarm = not s["alarmed"] and at - s["since"] >= stall
            s["alarmed"] |= alarm
            out.append(row(s, at, "stalled" if alarm else "progress"))
        if s and s["at"] + expire <= passed:
            out.append(row(s, s["at"] + expire, "gone"))
            s = None
        return s, recent if s else []

    def follow(key: tuple, frames: Iterator, state: object) -> Iterator:
        import json

        import pandas as pd

        passed = state.getCurrentWatermarkMs() * 1000
        polls, recent, s = json.loads(state.get[0]) if state.exists else ([], [], None)
        whole = lambda x: int(x) if isinstance(x, str) else None
        for frame in () if state.hasTimedOut else frames:
            polls += [
                [int(at), phase if isinstance(phase, str) else None, whole(done), whole(total)]
                for at, phase, done, total in zip(frame["at"], frame["phase"], frame["done"], frame["total"], strict=True)
                if at > passed
            ]
        due = {p[0]: p for p in sorted((p for p in polls if p[0] <= passed), key=order)}  # the largest of one time stays
        later = [p for p in polls if p[0] > passed]
        out: list[tuple] = []
        s, recent = told(s, recent, list(due.values()), passed, out)
        if s or later:
            state.update((json.dumps([later, recent, s]),))
            # A timeout comes when the watermark is beyond it, and the earliest that is needed has to be reached.
            wake = min([*([s["at"] + expire] if s else ()), *(p[0] for p in later)])
            state.setTimeoutTimestamp(-(-wake // 1000) - 1)
        elif state.exists:
            state.remove()
        if out:
            own = tuple(None if pd.isna(k) else k for k in key)
            yield pd.DataFrame([(*own, *r) for r in out], columns=names, dtype=object)

    return follow

"""Run queries and oracles side by side: ``python -m checks.compare SF_DIR [name …]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

from checks.oracles import ORACLES
from checks.queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results as bags of rows, or None."""
    result = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(result.columns):
        return f"columns {names} / {sorted(result.columns)}"
    ours = Counter(tuple(_cell(r[n]) for n in names) for r in df.toLocalIterator())
    order = [result.columns.index(n) for n in names]
    theirs = Counter(tuple(_cell(r[i]) for i in order) for r in result.fetchall())
    if ours == theirs:
        types = {type(v) for row in ours for v in row} - {type(None)}
        odd = {t for t in types if t not in (int, float, str, bool)}
        return f"types {odd}" if odd else None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{ours.total()} / {theirs.total()} rows, {only_ours.total()} / {only_theirs.total()} differ on {names};"
        f" e.g. {sorted(only_ours, key=str)[:2]} / {sorted(only_theirs, key=str)[:2]}"
    )


def main(sf_dir: str, names: list[str]) -> int:
    from fleetlens.plans.session import build_session

    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if name not in ORACLES or (names and not any(n in name for n in names)):
            continue
        start = time.time()
        try:
            found = difference(query(spark, sf_dir), con, ORACLES[name])
        except Exception as e:  # noqa: BLE001 - report and go on
            found = f"{type(e).__name__}: {str(e)[:500]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))

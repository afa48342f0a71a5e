"""Wall time of every registered batch query; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the input and
``BENCH_CPUS`` the local cores. Each query is computed in full into a sink that
discards rows; building it counts too, as walks run jobs while they are built.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from checks.queries import QUERIES  # noqa: E402
from fleetlens.plans.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    only = sys.argv[1:]
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the JVM's readers and of code generation is not a query's.
    QUERIES["r24_wait_events"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, query in QUERIES.items():
        if name.startswith("st") or (only and not any(n in name for n in only)):
            continue
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline metrics; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEATS  timed runs per query after one warm-up run (default 3; the median counts)
BENCH_QUERIES  comma-separated query names (default: the metrics over all history)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tallychain.registry import CHECKS
from tallychain.registry.metric_checks import ORACLES
from tallychain.session import local_session

# Aliases of other metrics are not timed twice.
ALIASES = {"nat_active_total", "nat_new_total"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    names = names or [n for n in ORACLES if n not in ALIASES]
    spark = local_session(cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        CHECKS[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds, spread = {}, {}
    for name in names:
        run(name)
        times = [run(name) for _ in range(repeats)]
        seconds[name] = round(statistics.median(times), 3)
        spread[name] = [round(min(times), 3), round(max(times), 3)]
    print(
        json.dumps(
            {
                "metric": "headline metrics, sum of median wall times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "spread": spread,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

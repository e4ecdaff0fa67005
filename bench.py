"""Benchmark the headline queries.

Runs each headline query on $BENCH_SF_DIR (default /root/testdata/sf0.1) with local[$BENCH_CPUS]
(default 8): one warm-up, then the median of $BENCH_REPS (default 3) timed runs. Each run executes
the whole plan into Spark's ``noop`` sink (no driver collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from flowlens.plans.registry import all_queries, headline
    from flowlens.session import get_spark

    spark = get_spark(f"local[{cpus}]", max(2 * int(cpus), 8),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = all_queries()
    names = only or headline()
    times: dict[str, float] = {}
    for name in names:
        def run():
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        run()  # warm-up
        times[name] = round(statistics.median(run() for _ in range(reps)), 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "cpus": int(cpus), "reps": reps}))


if __name__ == "__main__":
    main()

"""Benchmark the headline queries.

Runs each query to completion with the ``noop`` sink (the whole plan is
executed, nothing is collected) on ``local[$BENCH_CPUS]`` over
``$BENCH_SF_DIR`` and prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "C10_feature_matrix",
    "C11_live_features",
    "C1_team_form",
    "C2_team_form_asof",
    "W1_W2_W3_team_form_rows",
    "C3_batting_features",
    "C4_bowling_features",
    "J9_team_strength_asof",
    "C7_h2h_asof",
    "C14_top_batters_per_pair",
    "A1_batting_scorecard",
    "A2_bowling_scorecard",
    "C12_batting_cards",
    "C15_h2h_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from kestrel.plans.catalog import QUERIES
    from kestrel.session import local_session
    ncpu = os.cpu_count() if cpus == "*" else int(cpus)
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", 2 * ncpu)),
                          app="kestrel-bench")
    # Local mode: the test files are single row groups, so parallelism comes
    # only from shuffles; keep AQE from coalescing small shuffles below one
    # partition per core. (On a cluster the 64 MB advisory size applies.)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(ncpu))
    # warm-up: JVM, parquet footers, Python worker start
    QUERIES["C1_team_form"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(int(os.environ.get("BENCH_REPEAT", "1"))):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

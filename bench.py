"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_latency_by_region",
    "j1_region_lpm",
    "j3_correlate",
    "j5_mismatches",
    "j6_asof_snapshot",
    "a1_window_rates",
    "a5_hist_percentiles",
    "a6_latency_summary",
    "w1_cursor",
    "w2_inflight",
    "w3_ewma",
    "t3_top_k",
    "r_rr_round_robin",
    "r_wt_weighted",
    "r_lb_latency_based",
    "r_ad_adaptive",
    "r_score_adaptive",
    "h1_health_fsm",
    "r2_limit_slack",
    "v8_duplicate_listener",
    "v14_summary",
)


def main() -> None:
    from dnslens.plans.catalog import QUERIES
    from dnslens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    # The first query of a JVM pays for class loading and code generation.
    QUERIES["flagship_latency_by_region"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
                "events": events,
                "events_per_sec": {n: round(events / s) for n, s in seconds.items() if not n.startswith("v")},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries: one JSON line, median of the timed runs after one warm-up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.plans.catalog import catalog  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = (
    "clock_panel_report asof_clock_state asof_next_tick_tolerance multi_horizon_vwap_labels dedupe_latest "
    "path_shape same_clock_surprise xs_relative mixed_target_clipped heat_neutral rank_ic_by_group "
    "pool_internal_eval score_buckets rank_bucket_curve topk_per_group capacity_fill execution_replay "
    "exposure_metrics variant_sweep feature_hygiene tick_feature_frame mechanism_ratio label_distribution_by_fee"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = local_session(cpus, "tickloom-bench")
    queries, rows = {}, {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            df = catalog()[name].run(spark, folder)
            # the sink consumes every column of every row and keeps nothing
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        queries[name] = round(statistics.median(times[1:]), 3)
        rows[name] = df.count()
        print(f"{name} {queries[name]}s {rows[name]} rows", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "rows": rows,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

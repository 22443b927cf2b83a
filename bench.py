"""Time the headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dripline.plans import registry
from dripline.session import build_session

HEADLINE = [
    "features_full",
    "features_known_persons",
    "slot_grid",
    "day_vectors",
    "five_day_shapes",
    "minmax_vectors",
    "hourly_by_type",
    "hourly_amount",
    "gap_groups",
    "person_type_pivot",
    "slot_profile",
    "peak_bands",
    "range_violations",
    "dedup_events",
    "version_compare",
    "iqr_fence",
    "regression_metrics",
    "ensemble_summary",
    "corr_matrix",
    "vif",
    "threshold_grid",
    "frame_stats",
    "dbscan_labels",
    "silhouette",
    "cluster_gate_interval",
    "append_merge",
    "gbt_global",
]

#: Seconds after which a query is not run again.
LONG = 8.0


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{base}/events.parquet").count()  # start-up is not a query
    times: dict[str, float] = {}
    for name in names:
        runs: list[float] = []
        # The median of three runs; a long query runs once.
        while len(runs) < 3 and sum(runs) < LONG:
            begin = time.perf_counter()
            # Every row is computed and dropped, nothing is collected.
            registry.QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        times[name] = round(median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(base.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {name: sec}, "sf": ...}

Each query is built and fully executed into Spark's ``noop`` sink (every row is
computed, nothing is collected); the reported time is the median of
``$BENCH_RUNS`` warm runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "impute_zero_margin",
    "training_table",
    "test_table",
    "features_full",
    "row_number_desc",
    "purchase_gaps",
    "features_all_customers",
    "scoring_features",
    "baseline_match",
    "smape_compare",
    "split_parts",
    "quality_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    if only == ["all"]:
        from marginkit import catalog as _c
        only = list(_c.queries())

    from marginkit import build_session, catalog

    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          extra={"spark.driver.memory": "16g"})
    registered = catalog.queries()
    timings: dict[str, float] = {}
    for name in only or HEADLINE:
        fn = registered[name]

        def run_once() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run_once()
        timings[name] = round(statistics.median(run_once() for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

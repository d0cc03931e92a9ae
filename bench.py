"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
HEADLINES = (
    "filtered_counts_year", "hazard_year", "dedupe_latest", "percentile_benchmark_levels", "deterministic_mode", "sessionize_runs", "event_union_lineage",
    "rule_match_exact_range_prefix", "clean_name_steps", "distinct_funnel", "fuzzy_ref_link", "candidate_search_topk", "remap_shared_members", "verdict_reasons", "scorecard_sorted", "dq_checks",
)


def main() -> None:
    from siltworks.plans import catalogue
    from siltworks.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    all_, took = catalogue.queries(), {}
    for name in HEADLINES:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            all_[name](spark, sf).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(min(best), 3)
    from siltworks import warehouse
    from siltworks.plans import builds
    from siltworks.sources.scratch import keeper

    began = time.perf_counter()
    for df in warehouse.build(builds.raw(spark, sf), warehouse.Settings(least_rated=1), keeper(spark)).values():
        df.write.format("noop").mode("overwrite").save()
    took["warehouse_build"] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

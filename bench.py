"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The one-time build (derive → clean → write) is timed as ``materialize_tables``;
each query then reads the written set and is fully executed with the ``noop``
sink (no collect to the driver).  A key that needs the raw or the updated set
includes its build the first time.
Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf", ...}.
``BENCH_QUERIES=all`` runs every registered key; ``BENCH_REPEAT=2`` also
records a warm second run.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "store_scorecard", "sla_by_store", "delivery_percentiles", "rolling_7day_sla", "monthly_store_pnl",
    "store_pnl_summary", "break_even", "monthly_growth", "customer_segments", "picker_productivity",
    "picker_vs_store_avg", "top_skus", "category_by_store", "substitution_acceptance", "sku_stockout",
    "demand_heatmap", "business_kpis", "key_findings", "cleaning_audit", "sample_exact_fraction",
    "stratified_flag", "pick_activity_build", "describe_numeric", "profile_nulls",
    "sink_roundtrip", "insights_export",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    import uuid
    # a fresh namespace so the one-time derive+clean build is timed, not reused
    os.environ.setdefault("STOREPULSE_NAMESPACE", f"bench-{uuid.uuid4().hex[:8]}")
    from storepulse.session import get_spark
    from storepulse.plans.registry import queries
    from storepulse.plans.tableset import clean_tables
    spark = get_spark(master=f"local[{cpus}]")
    qs = queries()
    t0 = time.perf_counter()
    clean_tables(spark, sf_dir)        # derive → clean → write the cleaned set (once)
    build = round(time.perf_counter() - t0, 3)
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(qs) if wanted == "all" else ([w for w in wanted.split(",") if w] or HEADLINE)
    names = [n for n in names if n in qs]
    times, warm = {"materialize_tables": build}, {}
    for n in names:
        for r in range(repeat):
            t0 = time.perf_counter()
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = round(time.perf_counter() - t0, 3)
            (times if r == 0 else warm)[n] = dt
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
           "n_queries": len(times)}
    if warm:
        out["warm_queries"] = warm
        out["warm_value"] = round(sum(warm.values()), 3)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

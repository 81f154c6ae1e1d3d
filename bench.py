"""Time the headline queries and print one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""
from __future__ import annotations

import json
import os
import time

from takt.catalog import collect, hidden
from takt.session import local_session

HEADLINE = ["bottleneck_features", "bottleneck_label", "defect_features", "defect_features_line", "pair_fifo", "assign_by_interval",
            "series_analytics", "warning_periods", "recurring_constraints", "station_economics", "priority_queue", "performance_trend",
            "latest_at_or_before", "alert_policies", "metric_table", "unit_threshold", "robust_trim", "merge_streams", "split_bus",
            "sequence_gaps", "corridor_load", "dwell_history"]

# Beside the headline: the parts that the published end-to-end figure includes, hypotheses at 3,000 draws and scoring.
EXTRA = {"station_posterior_k3000": lambda spark, d: hidden.posterior(spark, d, 3000), "score_features": lambda spark, d: collect()[0]["score_features"](spark, d)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    queries = collect()[0]
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    extra = {}
    for name, query in EXTRA.items() if names is HEADLINE else ():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        extra[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "extra": extra,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "source_events": events,
                      "events_per_sec": {n: round(events / t) for n, t in times.items() if n in ("bottleneck_features", "defect_features", "series_analytics", "recurring_constraints")}}))


if __name__ == "__main__":
    main()

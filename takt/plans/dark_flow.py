"""The station flow columns of hidden stations, from a reconstructed queue ledger."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.contracts import FLOW_FEATURES
from takt.functions import scalar as sc
from takt.plans.station_flow import window_stats
from takt.session import cut_lineage


def dark_features(ledger: DataFrame, rates: DataFrame, priors: DataFrame, stations: DataFrame) -> DataFrame:
    """``ledger``: run_id, station_id, t_ms, queue_mean, queue_std, confidence (one row per station and
    time); ``rates``: expected crossings; ``priors``: run_id, station_id, mean, std in seconds."""
    e = ledger.select("run_id", "station_id", F.col("t_ms").alias("timestamp_ms"), F.col("t_ms").alias("event_sequence"),
                      F.greatest(F.lit(0.0), F.col("queue_mean")).alias("queue_length_after"), F.lit(None).cast("double").alias("cycle_time_ms"),
                      F.lit("RECONSTRUCTED").alias("event_type"))
    s = window_stats(cut_lineage(e)).drop("arrivals", "services", "prev_arrivals", "prev_services", "cycle_mean", "cycle_std", "cycle_max", "station_last_ts")
    keys = ["run_id", "station_id"]
    line = stations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_stations"))
    dim = stations.join(line, "run_id").select(*keys, "archetype", "base_cycle_time_ms", "cycle_time_std_ms", F.col("buffer_capacity").cast("double").alias("cap"),
                                               sc.station_index("station_id").alias("station_index"), "n_stations")
    # 99 % quantile of a gamma with this shape (Wilson-Hilferty), spread = 1 / (3 sqrt(shape))
    spread = F.col("std") / (3 * F.col("mean"))
    p = priors.select(*keys, (F.col("mean") * 1000).alias("cycle_mean"), (F.col("std") * 1000).alias("cycle_std"),
                      (F.col("mean") * F.pow(1 - spread * spread + 2.3263478740408408 * spread, 3) * 1000).alias("cycle_max"))
    r = rates.select(*keys, F.col("t_ms").alias("ts"), "arrivals10", "arrivals_prev", "services10", "services_prev")
    u = ledger.select(*keys, F.col("t_ms").alias("ts"), F.col("queue_std").alias("occ_std"), F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))).alias("conf"))
    j = s.join(u, [*keys, "ts"]).join(r, [*keys, "ts"], "left").join(dim, keys).join(p, keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    occ, cap = F.col("occupancy"), F.col("cap")
    return j.select(
        "run_id", F.col("ts").alias("prediction_time"), (cap - occ).alias("capacity_headroom"), "station_id", "base_cycle_time_ms",
        F.col("archetype").alias("station_archetype"), F.col("cycle_time_std_ms").alias("configured_cycle_std_ms"), "station_index", cap.alias("buffer_capacity"),
        sc.line_fraction("station_index", "n_stations").alias("line_fraction"), F.col("queue_max").alias("queue_max_10m"), F.col("queue_mean").alias("queue_mean_10m"),
        occ.alias("current_occupancy"), F.col("queue_std").alias("queue_std_10m"), sc.utilization(occ, cap).alias("capacity_utilization"),
        (z("arrivals_prev") / 10).alias("arrival_rate_per_min_prev10m"), (z("services_prev") / 10).alias("service_rate_per_min_prev10m"),
        (z("services10") / 10).alias("service_rate_per_min_10m"), (z("arrivals10") / 10).alias("arrival_rate_per_min_10m"),
        (1 - sc.utilization(occ, cap)).alias("utilization_headroom"), F.col("cycle_max").alias("cycle_max_10m"), (z("arrivals10") - z("services10")).alias("flow_pressure_10m"),
        (F.col("queue_mean") - F.col("prev_queue_mean")).alias("queue_delta_10m"), F.col("cycle_mean").alias("cycle_mean_10m"), F.col("slope").alias("queue_slope_10m"),
        ((z("arrivals10") - z("services10")) / 10).alias("net_flow_rate_10m"), F.col("cycle_std").alias("cycle_std_10m"), F.col("conf").alias("state_confidence"),
        F.col("occ_std").alias("progress_std"), sc.eta_std_dark(cap - occ, F.col("slope"), F.col("slope_se"), F.col("occ_std")).alias("eta_std")
    ).select("run_id", "prediction_time", *FLOW_FEATURES)

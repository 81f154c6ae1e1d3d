"""Table schemas, frozen feature orders and the constants every operator shares."""
from __future__ import annotations

from pyspark.sql import types as T

RECENT_MS = 600_000
HORIZON_MS = 1_800_000
SIGNALS = ["TORQUE", "VIBRATION", "TEMPERATURE", "CURRENT"]
BOUNDARY_EVENTS = ["DARK_ZONE_ENTERED", "DARK_ZONE_EXITED"]
LOW_CONFIDENCE = 0.75

# Names and order of the station flow feature contract.
FLOW_FEATURES = [
    "capacity_headroom", "station_id", "base_cycle_time_ms", "station_archetype",
    "configured_cycle_std_ms", "station_index", "buffer_capacity", "line_fraction",
    "queue_max_10m", "queue_mean_10m", "current_occupancy", "queue_std_10m",
    "capacity_utilization", "arrival_rate_per_min_prev10m", "service_rate_per_min_prev10m",
    "service_rate_per_min_10m", "arrival_rate_per_min_10m", "utilization_headroom",
    "cycle_max_10m", "flow_pressure_10m", "queue_delta_10m", "cycle_mean_10m",
    "queue_slope_10m", "net_flow_rate_10m", "cycle_std_10m", "state_confidence",
    "progress_std", "eta_std",
]
# Names and order of the unit quality feature contract.
QUALITY_FEATURES = [
    "torque_delta_recent_vs_history", "manual_fail_count_cum", "prediction_station_index",
    "torque_mean_history", "line_fraction", "last_manual_fail", "manual_check_count_cum",
    "torque_mean_recent", "queue_history_mean", "current_mean_recent", "current_missing_recent",
    "vibration_delta_recent_vs_history", "current_mean_history", "torque_max_recent",
    "temperature_mean_history", "torque_max_history", "supplier_batch", "current_max_history",
    "cycle_history_max", "temperature_max_recent", "vibration_mean_history",
    "temperature_max_history", "stations_since_last_manual_fail", "vehicle_model",
    "vibration_max_history", "vibration_max_recent", "temperature_mean_recent",
    "torque_std_history", "queue_history_std", "cycle_history_std",
]
FLOW_META = ["run_id", "station_id_buffer_id", "prediction_time", "prediction_event_sequence",
             "capacity", "currently_at_capacity", "target_eligibility_status"]
QUALITY_META = ["run_id", "unit_id", "prediction_station", "prediction_time",
                "prediction_event_sequence", "label_completeness_status", "final_station_index"]


def _struct(ddl: str) -> T.StructType:
    """Plain column list of Spark DDL to a schema, without a running session."""
    out = T.StructType()
    for part in ddl.split(","):
        out = out.add(*part.split())
    return out


# Column names and types of the run folder's tables (run_id comes from the folder name).
TABLES = {
    "stations": _struct("station_id string, name string, archetype string, base_cycle_time_ms long, cycle_time_std_ms long, "
        "buffer_capacity integer, sensor_coverage string"),
    "units": _struct("unit_id string, created_at_ms long, vehicle_model string, supplier_batch string"),
    "station_events": _struct("event_id string, timestamp_ms long, event_type string, station_id string, unit_id string, "
        "queue_length_after double, previous_state string, new_state string, cycle_time_ms double, "
        "dark_zone_id string"),
    "sensor_readings": _struct("timestamp_ms long, station_id string, sensor_type string, value double, unit string"),
    "manual_checks": _struct("timestamp_ms long, station_id string, unit_id string, check_type string, result string"),
    "inspection_results": _struct("timestamp_ms long, station_id string, unit_id string, defect_type string, severity integer, "
        "result string"),
    "checkpoint_events": _struct("event_id string, timestamp_ms long, event_type string, station_id string, unit_id string, "
        "checkpoint_id string"),
    "station_checkpoints": _struct("station_id string, checkpoint_id string, checkpoint_type string, nominal_progress_fraction double, "
        "read_reliability double, false_positive_rate double, identifies_unit boolean"),
    "dark_zones": _struct("dark_zone_id string, name string, start_station_id string, end_station_id string, "
        "sensor_telemetry boolean, manual_checks boolean, checkpoints boolean"),
    "runtime_bus": _struct("sequence long, timestamp_ms long, record_type string, event_id string, event_type string, "
        "station_id string, unit_id string, queue_length_after double, previous_state string, "
        "new_state string, cycle_time_ms double, dark_zone_id string, checkpoint_id string, "
        "sensor_type string, sensor_value double, sensor_unit string, check_type string, check_result string"),
    "run_metadata": _struct("run_id string, random_seed long, simulation_duration_ms long, station_count integer, "
        "units_created integer, schema_version string"),
    "runtime_health": _struct("run_id string, status string, bottleneck_status string, defect_status string"),
    "prediction_manifest": _struct("run_id string, predictions_dir string, run_dir string, generated_at string"),
}

# Columns of the two prediction streams.
_DRIVER = T.ArrayType(_struct("feature string, value string, shap_log_odds double, direction string"))
_DEFECT_DRIVER = T.ArrayType(_struct("feature string, label string, feature_value string, shap_value_raw double, "
        "absolute_shap_value double, effect string"))
PREDICTIONS = {
    "bottleneck": T.StructType(
        _struct("schema_version string, run_id string, timestamp_ms long, station_id string, vehicle_id string, "
        "zone string, route string, prediction_trigger string, bottleneck_probability double, "
        "bottleneck_risk_percent double, warning boolean, decision_threshold double, "
        "decision_threshold_percent double, state_confidence double, event_id string, event_sequence long").fields
        + [T.StructField("explanation", T.StructType(
            [T.StructField("top_drivers", _DRIVER)]
            + _struct("base_margin double, explained_probability double, probability_additivity_error double, "
        "best_iteration_explained integer").fields))]),
    "defect": T.StructType(
        _struct("run_id string, unit_id string, station_id string, timestamp_ms long, station_index integer, "
        "final_inspection_station string, defect_probability double, defect_risk_percent double, "
        "raw_defect_probability double, warning boolean, threshold_crossed boolean, alert_policy string, "
        "alert_policy_score double, decision_threshold double, route string, prediction_trigger string, "
        "state_confidence double, data_source string, estimated_transition_time_ms long, "
        "transition_confirmation_lag_ms long").fields
        + [T.StructField("top_risk_drivers", _DEFECT_DRIVER),
           T.StructField("top_protective_drivers", _DEFECT_DRIVER)]),
}


def frozen_projection(df, columns: list[str]):
    """Exactly these columns in this order, or an error naming what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("feature contract broken, missing: " + ", ".join(missing))
    return df.select(*columns)

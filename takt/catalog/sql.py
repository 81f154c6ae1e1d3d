"""DuckDB text of the bindings, used as CTE preludes of the oracle queries."""
from __future__ import annotations

_CTES = {
    "line_log": """
  SELECT 'run_' || lpad(CAST(day(ts) AS VARCHAR), 4, '0') AS run_id, CAST(day(ts) AS INTEGER) AS production_day,
    CAST((epoch_us(ts) % 86400000000) // 12000 AS BIGINT) AS timestamp_ms, event_id AS event_sequence,
    CAST(user_id % 12 AS INTEGER) AS station_index,
    'S' || lpad(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') AS station_id,
    'U' || lpad(CAST((user_id // 12) % 5 + 1 AS VARCHAR), 6, '0') AS unit_id,
    CASE event_type WHEN 'click' THEN 'SENSOR' WHEN 'error' THEN 'MANUAL' ELSE 'STATION' END AS record_type,
    CASE event_type WHEN 'signup' THEN 'UNIT_ARRIVED' WHEN 'view' THEN 'PROCESSING_STARTED'
      WHEN 'purchase' THEN 'PROCESSING_COMPLETED' END AS event_type,
    CASE WHEN event_type NOT IN ('click', 'error') AND event_id % 7 <> 0
      THEN CAST(CAST(floor(value) AS BIGINT) % 6 AS DOUBLE) END AS queue_length_after,
    CASE WHEN event_type = 'purchase' THEN floor(value * 1000) END AS cycle_time_ms,
    CASE WHEN event_type = 'click' THEN list_extract(['TORQUE','VIBRATION','TEMPERATURE','CURRENT'],
      CAST(event_id % 4 + 1 AS BIGINT)) END AS sensor_type,
    CASE WHEN event_type = 'click' THEN floor(value) END AS sensor_value,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'FAIL' ELSE 'PASS' END END AS check_result,
    floor(value) AS amount, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id
  FROM events""",
    "ev": "SELECT * FROM line_log WHERE record_type = 'STATION'",
    "se": "SELECT *, sensor_value AS value FROM line_log WHERE record_type = 'SENSOR'",
    "ma": "SELECT *, check_result AS result FROM line_log WHERE record_type = 'MANUAL'",
    "ins": "SELECT * FROM ma WHERE station_index = 10",
    "runs": "SELECT DISTINCT run_id, production_day FROM line_log",
    "stations": """
  SELECT run_id, 'S' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') AS station_id, CAST(i AS INTEGER) AS station_index,
    'Station ' || CAST(i + 1 AS VARCHAR) AS name,
    CASE WHEN i IN (5, 10) THEN 'INSPECTION' WHEN i = 7 THEN 'MANUAL' ELSE 'AUTOMATED' END AS archetype,
    36000 + 1000 * i AS base_cycle_time_ms, (36000 + 1000 * i) // 10 AS cycle_time_std_ms,
    CAST(CASE WHEN i = 0 THEN 0 ELSE 3 + i % 3 END AS INTEGER) AS buffer_capacity,
    CASE WHEN i = 7 THEN 'NONE' ELSE 'HIGH' END AS sensor_coverage, i BETWEEN 3 AND 5 AS is_dark
  FROM runs, range(12) AS r(i)""",
    "units": """
  SELECT DISTINCT run_id, unit_id,
    CASE WHEN CAST(substr(unit_id, 2) AS INTEGER) % 5 = 0 THEN 'MODEL_B' ELSE 'MODEL_A' END AS vehicle_model,
    'BATCH_' || CAST(CAST(substr(unit_id, 2) AS INTEGER) % 3 AS VARCHAR) AS supplier_batch
  FROM line_log""",
    "zones": """
  SELECT run_id, 'DZ01' AS dark_zone_id, 'S04' AS start_station_id, 'S06' AS end_station_id,
    true AS sensor_telemetry, true AS manual_checks, true AS checkpoints FROM runs""",
    "preds": """
  SELECT run_id, production_day, station_id, station_index, unit_id, timestamp_ms, event_id AS emission,
    least(1.0, amount / 200) AS probability, (event_id % 10 + 1) / 10.0::DOUBLE AS state_confidence,
    CASE WHEN station_index BETWEEN 3 AND 5 THEN 'DARK' ELSE 'LIGHT' END AS zone,
    CASE WHEN station_index BETWEEN 3 AND 5 THEN 'DARK_CORRIDOR' ELSE 'LIGHT' END AS route, k
  FROM line_log""",
    "bp": "SELECT *, probability * 100 AS risk_percent, 0.25::DOUBLE AS threshold, probability >= 0.25 AS warning FROM preds",
    "dp": """
  SELECT *, probability * 100 AS risk_percent, 0.5::DOUBLE AS threshold, probability >= 0.5 AS threshold_crossed,
    probability >= 0.5 AND station_index < 10 AS warning, 'S11' AS final_station FROM preds""",
    "scored": """
  SELECT d.source AS run_id, CAST(l.doc_id AS VARCHAR) AS unit_id, l.doc_id, d.lang, 1 - l.quality AS y,
    (d.n_chars % 1000) / 1000.0::DOUBLE AS score, CAST(d.n_chars % 12 AS INTEGER) AS station_index,
    10 AS final_index, l.doc_id AS seq
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "series": "SELECT run_id, lang AS unit_id, doc_id, y, score, station_index, final_index, seq FROM scored",
}
_NEEDS = {
    "ev": ["line_log"], "se": ["line_log"], "ma": ["line_log"], "ins": ["ma"], "runs": ["line_log"],
    "stations": ["runs"], "units": ["line_log"], "zones": ["runs"], "preds": ["line_log"], "bp": ["preds"],
    "dp": ["preds"], "series": ["scored"],
}


def with_ctes(names: str, body: str, **extra: str) -> str:
    """``WITH`` prelude holding the named bindings (and what they need), extra CTEs, then the body."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS ({_CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    body = body.lstrip()
    # a body may start with ", name AS (...)" to add CTEs of its own
    return "WITH " + ",\n".join(parts) + ("" if body.startswith(",") else "\n") + body

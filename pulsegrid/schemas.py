"""Canonical schemas of the analytics and state tables, as DDL text."""

from pulsegrid.fixed import STATUS_FEATURES

TELEMETRY_LONG = (
    "timestamp TIMESTAMP, device_serial STRING, variable_id INT, value DOUBLE, "
    + ", ".join(f"{c} BOOLEAN" for c in STATUS_FEATURES)
)
SCORES = (
    "device_serial STRING, window_start TIMESTAMP, window_end TIMESTAMP, timestamp TIMESTAMP, "
    "anomaly_score DOUBLE, fleet_percentile DOUBLE"
)
ALERT_HISTORY = (
    "id BIGINT, device_serial STRING, timestamp TIMESTAMP, alert_level STRING, "
    "anomaly_score DOUBLE, fleet_percentile DOUBLE, notified BOOLEAN, notified_at TIMESTAMP"
)
SYSTEM_HEALTH = (
    "id BIGINT, timestamp TIMESTAMP, job_name STRING, status STRING, duration_ms BIGINT, "
    "rows_processed BIGINT, error_message STRING"
)
WORK_ORDERS = (
    "work_order_id STRING, work_order_type STRING, registered_date DATE, completed_date DATE, "
    "fault_description STRING, technical_description STRING, device_reg INT, "
    "serial_number STRING, import_filename STRING, imported_at TIMESTAMP, matched BOOLEAN"
)
FEEDBACK_LABELS = (
    "id BIGINT, device_serial STRING, date DATE, event_type STRING, work_order_id STRING, "
    "matched_alert_id BIGINT, notes STRING, created_at TIMESTAMP, source STRING"
)
MODEL_VERSIONS = (
    "version_id BIGINT, trained_at TIMESTAMP, label_count INT, confirmed_count INT, "
    "model_path STRING, performance_snapshot STRING, active BOOLEAN"
)
ATTRIBUTION_CACHE = (
    "id BIGINT, device_serial STRING, computed_at TIMESTAMP, window_start STRING, "
    "window_end STRING, result_json STRING"
)

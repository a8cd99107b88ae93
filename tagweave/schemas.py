"""Explicit schemas of the data contracts."""

ENVELOPE_VALUE = (
    "tag string, value double, unit string, timestamp string, quality string, param string, "
    "asset string, name string, uns_topic string, source string, filename string, "
    "file_ts string, reading_id string, row_index long"
)

ENVELOPE = (
    "topic string, partition int, offset long, key string, timestamp string, "
    f"headers map<string,string>, value struct<{ENVELOPE_VALUE.replace(' string', ':string').replace(' double', ':double').replace(' long', ':long')}>"
)

BRONZE_COLUMNS = [
    "kafka_offset", "kafka_topic", "kafka_partition", "tag", "value", "unit", "ts_raw", "quality",
    "param", "asset", "name", "uns_topic", "source", "filename", "medallion_zone",
]

SILVER_COLUMNS = [
    "tag", "param", "asset", "value", "unit", "ts", "quality", "uns_topic", "source",
    "bronze_offset", "medallion_zone", "schema_version",
]

GOLD_COLUMNS = [
    "tag", "param", "asset", "value", "unit", "ts", "quality", "uns_topic", "source",
    "bronze_offset", "grain", "ready_for", "medallion_zone", "context_status",
]

FLAT_COLUMNS = [
    "reading_id", "timestamp", "param", "short", "name", "tag", "value", "unit", "status", "zone",
    "delta", "spec", "asset", "asset_name", "line", "batch", "product", "phase", "operator_shift",
    "mes_window", "material_no", "family", "grade", "equipment", "spec_source",
    "calibration_age_days", "probe_calibration_date", "last_maintenance", "lab_note_ref",
]

AUDIT_COLUMNS = ["chain", "segment", "seq", "ts", "actor", "action", "payload", "prev_hash", "hash"]

"""Schemas of the stored tables, and the fixed name lists of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the log data model.
LOG_TYPES = ["API_REQUEST", "DATABASE_QUERY", "USER_ACTION", "SYSTEM_EVENT", "ERROR"]
LOG_LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "CRITICAL"]

# The columns a feature table offers to its readers, in order.
FEATURE_TABLE = [
    "log_id", "timestamp", "log_type",
    "hour", "day_of_week", "is_weekend", "is_business_hours",
    "log_level_encoded", "log_type_indexed",
    "count_5min", "count_15min", "count_1hour", "avg_response_time_5min", "max_response_time_5min",
    "response_time_zscore", "is_slow_response",
    "response_time_lag_1", "response_time_lag_2", "response_time_lag_3",
    "count_lag_1", "count_lag_2", "count_lag_3",
    "is_anomaly", "response_time_ms", "message",
]
# Columns later steps need as well, kept beside them.
FEATURE_TABLE_EXTRA = ["log_level", "user_id", "status_code"]

# Model inputs of the forest and of the sequence model.
FOREST_FEATURES = [
    "hour", "day_of_week", "is_weekend", "is_business_hours",
    "log_level_encoded", "log_type_indexed",
    "count_5min", "count_15min", "count_1hour", "avg_response_time_5min", "max_response_time_5min",
    "response_time_zscore", "is_slow_response",
    "response_time_lag_1", "response_time_lag_2", "response_time_lag_3",
    "count_lag_1", "count_lag_2", "count_lag_3",
]
SEQUENCE_FEATURES = [
    "hour", "day_of_week", "log_level_encoded", "log_type_indexed", "count_5min",
    "avg_response_time_5min", "max_response_time_5min", "response_time_zscore",
]


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
}


def struct(text: str) -> T.StructType:
    """Schema from ``name type`` pairs; unlike the DDL reader it needs no running session."""
    fields = (pair.split() for pair in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


RAW_LOGS = struct(
    "log_id string, timestamp timestamp_ntz, log_level string, log_type string, message string,"
    " extra_data string, is_anomaly boolean"
)

# Keys the payload of a log record may hold; a record has only those of its type.
LOG_PAYLOAD = struct(
    "endpoint string, status_code int, response_time_ms double, user_id string, query_type string,"
    " execution_time_ms double, rows_affected int, action string, session_id string, service string,"
    " error_count int, failed_attempts int, ip_address string, memory_usage_percent double,"
    " cpu_usage_percent double"
)

LOGS_METADATA = struct(
    "id bigint, batch_id string, total_logs bigint, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz,"
    " processing_time_seconds double, created_at timestamp_ntz"
)
ANOMALIES = struct(
    "id bigint, log_id string, timestamp timestamp_ntz, log_level string, log_type string, message string,"
    " anomaly_score double, model_name string, model_version string, features string, detected_at timestamp_ntz,"
    " is_confirmed boolean, feedback string, notes string"
)
MODEL_PERFORMANCE = struct(
    "id bigint, model_name string, model_version string, metric_name string, metric_value double,"
    " evaluation_date date, dataset_size bigint, notes string, created_at timestamp_ntz"
)
FEATURE_STATISTICS = struct(
    "id bigint, feature_name string, stat_type string, stat_value double, calculation_date date,"
    " sample_size bigint, created_at timestamp_ntz"
)
ALERTS = struct(
    "id bigint, anomaly_id bigint, severity string, alert_type string, description string, status string,"
    " created_at timestamp_ntz, acknowledged_at timestamp_ntz, resolved_at timestamp_ntz"
)

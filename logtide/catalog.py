"""Registered queries: every operator over the given tables, with the SQL that must give the same rows.

``events`` is read as application logs; scores, result tables and labels are derived from them, so all
work grows with the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide import inputs, schemas
from logtide.functions import logs as fn
from logtide.models import forest, sequence
from logtide.operators import (
    detectors, drift, enrich, evaluate, features, jobs, monitor, reports, results, scoring, sketches, summary, text,
)
from logtide.plans.materialize import ensure_checkpoint_dir, materialize
from logtide.plans.quantiles import exact_quantile
from logtide.sources import logs as sources

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the order of additions is not fixed."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, digits: int = 6):
    """Register a query, and its SQL when it can be said in SQL. ``digits`` is raised where means of
    decimal numbers often end in a 5 at the seventh digit, which rounds either way."""
    def register(function: Query) -> Query:
        name = function.__name__
        _QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir), digits)
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


# --- inputs -----------------------------------------------------------------------------------------------

logs = inputs.logs_from_events


def scored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with a fixed score; rows with a helper value below 2, about two percent, have none."""
    rows = logs(spark, sf_dir).withColumn(
        "if_score", F.when(F.col("k") >= 2, F.least(F.col("value") / 200.0, F.lit(1.0))))
    return scoring.combine_scores(rows).withColumn("is_anomaly_actual", F.col("is_anomaly"))


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def anomaly_batch(scored: DataFrame) -> DataFrame:
    return scoring.anomaly_rows(scored).withColumn("detected_at", F.col("timestamp"))


def anomaly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly table after one batch of all scored logs."""
    return results.upsert_anomalies(empty(spark, schemas.ANOMALIES), anomaly_batch(scored_logs(spark, sf_dir)))


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the anomaly table; every third acknowledged, of the others every fifth resolved."""
    alerts = results.create_alerts(empty(spark, schemas.ALERTS), anomaly_table(spark, sf_dir))
    return results.move_alerts(alerts, alert_changes(alerts))[0]


def alert_changes(alerts: DataFrame) -> DataFrame:
    status = F.when(F.col("id") % 3 == 0, "acknowledged").when(F.col("id") % 5 == 0, "resolved")
    return alerts.select("id", status.alias("new_status"), (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias(
        "changed_at")).filter(F.col("new_status").isNotNull())


def performance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quality of two cuts of the fixed score, as rows of the metric table."""
    scored = scored_logs(spark, sf_dir).withColumn("evaluation_date", F.to_date("timestamp"))
    parts = []
    for model, cut in (("isolation_forest", 0.5), ("statistical", 0.3)):
        flagged = scored.withColumn("flag", (F.col("combined_score") > cut).cast("int"))
        daily = evaluate.evaluate(flagged, "is_anomaly_actual", "flag", ["evaluation_date"])
        parts.append(evaluate.metric_rows(daily).withColumn("model_name", F.lit(model)))
    # one row per model, metric and day, so the date decides which value is newest
    return parts[0].unionByName(parts[1]).withColumn("id", F.lit(0).cast("long"))


#: The log table in SQL, written apart from ``inputs``.
LOGS_SQL = """SELECT 'log_' || event_id AS log_id, ts AS timestamp, t AS log_type, k,
  CASE WHEN t = 'API_REQUEST' THEN code END AS status_code, CASE WHEN t = 'API_REQUEST' THEN value END AS response_time_ms,
  CASE WHEN t = 'DATABASE_QUERY' THEN value END AS execution_time_ms,
  CASE WHEN t = 'ERROR' THEN 'ERROR' WHEN t = 'SYSTEM_EVENT' AND k >= 95 THEN 'CRITICAL'
    WHEN t = 'API_REQUEST' AND code > 400 THEN 'WARN' WHEN t = 'DATABASE_QUERY' AND k < 50 THEN 'DEBUG'
    ELSE 'INFO' END AS log_level,
  CASE WHEN t IN ('USER_ACTION', 'API_REQUEST') THEN 'user_' || user_id END AS user_id,
  CASE t WHEN 'ERROR' THEN 'worker stopped without answer' WHEN 'SYSTEM_EVENT' THEN 'heartbeat of node fine'
    WHEN 'USER_ACTION' THEN format('visitor opened page {}', k)
    WHEN 'DATABASE_QUERY' THEN format('SELECT over shelf {} gave rows', k)
    ELSE format('GET /shelf answered {} after {}ms', code, k) END AS message,
  (t = 'ERROR' AND k > 89) OR value >= 150 AS is_anomaly, event_id, value
FROM (SELECT *, [200, 200, 200, 200, 200, 200, 206, 301, 429, 503][k % 10 + 1]::INTEGER AS code FROM (
  SELECT *, (props::JSON ->> 'k')::INTEGER AS k, CASE event_type WHEN 'signup' THEN 'SYSTEM_EVENT'
    WHEN 'purchase' THEN 'DATABASE_QUERY' WHEN 'view' THEN 'API_REQUEST' WHEN 'click' THEN 'USER_ACTION' ELSE 'ERROR'
    END AS t FROM events))"""
WITH_LOGS = f"WITH logs AS ({LOGS_SQL})"
WITH_SCORED = WITH_LOGS + """, scored AS (
  SELECT *, coalesce(if_score, 0.0) AS combined_score,
    CAST(CASE WHEN coalesce(if_score, 0.0) > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS is_anomaly_predicted,
    is_anomaly AS is_anomaly_actual
  FROM (SELECT *, CASE WHEN k >= 2 THEN least(value / 200.0, 1.0) END AS if_score FROM logs))"""
WITH_ANOMALIES = WITH_SCORED + """, anomalies AS (
  SELECT row_number() OVER (ORDER BY timestamp, log_id) AS id, log_id, timestamp, log_level, log_type, message,
    combined_score AS anomaly_score, 'ensemble' AS model_name, 'v1.0' AS model_version, '{}' AS features,
    timestamp AS detected_at, false AS is_confirmed, CAST(NULL AS VARCHAR) AS feedback, CAST(NULL AS VARCHAR) AS notes
  FROM scored WHERE is_anomaly_predicted = 1)"""
WITH_NEW_ALERTS = WITH_ANOMALIES + """, new_alerts AS (
  SELECT row_number() OVER (ORDER BY detected_at, id) AS id, id AS anomaly_id,
    CASE WHEN anomaly_score > 0.95 THEN 'critical' WHEN anomaly_score > 0.8 THEN 'high'
      WHEN anomaly_score > 0.6 THEN 'medium' ELSE 'low' END AS severity,
    'anomaly_score' AS alert_type, message AS description, 'open' AS status, detected_at AS created_at
  FROM anomalies WHERE anomaly_score > 0.8)"""
WITH_ALERTS = WITH_NEW_ALERTS + """, alerts AS (
  SELECT id, anomaly_id, severity, alert_type, description,
    CASE WHEN id % 3 = 0 THEN 'acknowledged' WHEN id % 5 = 0 THEN 'resolved' ELSE 'open' END AS status, created_at,
    CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 1 HOUR END AS acknowledged_at,
    CASE WHEN id % 3 <> 0 AND id % 5 = 0 THEN created_at + INTERVAL 1 HOUR END AS resolved_at
  FROM new_alerts)"""
WITH_PERFORMANCE = WITH_SCORED + """, cuts AS (
  SELECT 'isolation_forest' AS model_name, 0.5 AS cut UNION ALL SELECT 'statistical', 0.3), daily AS (
  SELECT model_name, CAST(timestamp AS DATE) AS evaluation_date, count(*) AS dataset_size,
    count(*) FILTER (WHERE is_anomaly_actual AND combined_score > cut) AS tp,
    count(*) FILTER (WHERE NOT is_anomaly_actual AND combined_score > cut) AS fp,
    count(*) FILTER (WHERE is_anomaly_actual AND NOT combined_score > cut) AS fn
  FROM scored CROSS JOIN cuts GROUP BY ALL), performance AS (
  SELECT model_name, evaluation_date, dataset_size, 'precision' AS metric_name,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS metric_value FROM daily
  UNION ALL SELECT model_name, evaluation_date, dataset_size, 'recall',
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END FROM daily
  UNION ALL SELECT model_name, evaluation_date, dataset_size, 'f1_score',
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END FROM daily)"""

_FRAME = "PARTITION BY log_type ORDER BY sec RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
_SEC = "CAST(floor(epoch(timestamp)) AS BIGINT)"
WITH_FEATURES = WITH_LOGS + f""", timed AS (SELECT *, {_SEC} AS sec FROM logs), stats AS (
  SELECT log_type, avg(response_time_ms) AS m, stddev_samp(response_time_ms) AS s,
    quantile_disc(response_time_ms, 0.95) AS p95,
    CAST(row_number() OVER (ORDER BY count(*) DESC, log_type) - 1 AS DOUBLE) AS log_type_indexed
  FROM logs GROUP BY log_type), rolling AS (
  SELECT timed.*, count(log_id) OVER ({_FRAME.format(300)}) AS count_5min,
    count(log_id) OVER ({_FRAME.format(900)}) AS count_15min,
    count(log_id) OVER ({_FRAME.format(3600)}) AS count_1hour,
    coalesce(avg(CASE WHEN log_type = 'API_REQUEST' THEN response_time_ms END) OVER ({_FRAME.format(300)}), 0.0)
      AS avg_response_time_5min,
    coalesce(max(CASE WHEN log_type = 'API_REQUEST' THEN response_time_ms END) OVER ({_FRAME.format(300)}), 0.0)
      AS max_response_time_5min
  FROM timed), features AS (
  SELECT log_id, timestamp, log_type, CAST(hour(timestamp) AS INTEGER) AS hour,
    CAST(dayofweek(timestamp) + 1 AS INTEGER) AS day_of_week,
    CAST(CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
    CAST(CASE WHEN hour(timestamp) BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS INTEGER) AS is_business_hours,
    CAST(CASE log_level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3
      WHEN 'CRITICAL' THEN 4 ELSE 0 END AS INTEGER) AS log_level_encoded,
    coalesce(log_type_indexed, 0.0) AS log_type_indexed, count_5min, count_15min, count_1hour,
    avg_response_time_5min, max_response_time_5min,
    CASE WHEN response_time_ms IS NOT NULL AND s > 0 THEN (response_time_ms - m) / s ELSE 0.0 END
      AS response_time_zscore,
    CAST(CASE WHEN response_time_ms > p95 THEN 1 ELSE 0 END AS INTEGER) AS is_slow_response,
    coalesce(lag(response_time_ms, 1) OVER o, 0.0) AS response_time_lag_1,
    coalesce(lag(response_time_ms, 2) OVER o, 0.0) AS response_time_lag_2,
    coalesce(lag(response_time_ms, 3) OVER o, 0.0) AS response_time_lag_3,
    coalesce(lag(count_5min, 1) OVER o, 0) AS count_lag_1, coalesce(lag(count_5min, 2) OVER o, 0) AS count_lag_2,
    coalesce(lag(count_5min, 3) OVER o, 0) AS count_lag_3, is_anomaly,
    coalesce(response_time_ms, 0.0) AS response_time_ms, message, log_level, user_id,
    coalesce(status_code, 0) AS status_code
  FROM rolling LEFT JOIN stats USING (log_type)
  WINDOW o AS (PARTITION BY log_type ORDER BY timestamp, log_id))"""


def _round_all(table: str, doubles: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles)}) FROM {table}"


# --- sources and projections ------------------------------------------------------------------------------

@query(WITH_LOGS + " SELECT log_id, timestamp, log_type, log_level, user_id, status_code,"
       " round(response_time_ms, 6) AS response_time_ms, message, is_anomaly FROM logs")
def scan_logs(spark, sf_dir):
    return logs(spark, sf_dir).select("log_id", "timestamp", "log_type", "log_level", "user_id", "status_code",
                                      "response_time_ms", "message", "is_anomaly")


_PAYLOAD = {  # key: (type, when, Spark and SQL expression)
    "endpoint": ("string", "event_type = 'view'", "concat('/shelf/', k)"),
    "status_code": ("int", "event_type = 'view'", "200 + k"),
    "response_time_ms": ("double", "event_type = 'view'", "k / 4.0D"),
    "user_id": ("string", "event_type IN ('view', 'click')", "concat('user_', user_id)"),
    "query_type": ("string", "event_type = 'purchase'", "'SELECT'"),
    "execution_time_ms": ("double", "event_type = 'purchase'", "k / 8.0D"),
    "rows_affected": ("int", "event_type = 'purchase'", "k * 3"),
    "action": ("string", "event_type = 'click'", "'open'"),
    "session_id": ("string", "event_type = 'click' AND k > 9", "concat('s-', k)"),
    "service": ("string", "event_type = 'signup'", "'node \"a\"'"),
    "error_count": ("int", "event_type = 'error'", "k"),
    "failed_attempts": ("int", "event_type = 'error' AND k > 50", "k - 50"),
    "ip_address": ("string", "event_type = 'error'", "concat('10.0.0.', k)"),
    "memory_usage_percent": ("double", "event_type = 'signup'", "k / 2.0D"),
    "cpu_usage_percent": ("double", "event_type = 'signup' AND k < 40", "k + 0.5D"),
}
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(f"SELECT event_id, " + ", ".join(
    f"CASE WHEN {when} THEN CAST({what.replace('D', '::DOUBLE') if kind == 'double' else what} AS "
    f"{ {'string': 'VARCHAR', 'int': 'INTEGER', 'double': 'DOUBLE'}[kind]}) END AS {key}"
    for key, (kind, when, what) in _PAYLOAD.items()) + f" FROM (SELECT *, {_K} AS k FROM events)")
def flatten_payload(spark, sf_dir):
    """Every key of the payload schema, each present in some records only."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.from_json("props", schemas.struct("k int"))["k"])
    fields = ", ".join(f"'{key}', CASE WHEN {when} THEN CAST({what} AS {kind}) END"
                       for key, (kind, when, what) in _PAYLOAD.items())
    rows = rows.select("event_id", F.to_json(F.expr(f"named_struct({fields})")).alias("extra_data"))
    return sources.flatten_payload(rows)


_MADE = """concat('{"k":', {k}, ',"tag":', CASE WHEN {k} % 3 = 0 THEN '"t"' WHEN {k} % 3 = 1 THEN '1.5' ELSE 'true' END,
  CASE WHEN {k} > 50 THEN ',"status_code":404,"extra":{{"a":[1]}}' ELSE '' END, '}}')"""


@query(f"""WITH rows AS (SELECT {_MADE.replace('{"k"', '{{"k"').format(k='k')}::JSON AS j FROM (SELECT *, {_K} AS k FROM events)),
  keys AS (SELECT j, unnest(json_keys(j)) AS payload_key FROM rows)
  SELECT payload_key, CASE json_type(j, '$.' || payload_key) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer'
    WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' END AS kind,
    count(*) AS count FROM keys GROUP BY ALL""")
def payload_keys(spark, sf_dir):
    """Keys and kinds of payloads that no schema describes."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.from_json("props", schemas.struct("k int"))["k"])
    return sources.payload_keys(rows.select(F.expr(_MADE.replace('{"k"', '{{"k"').format(k="k")).alias("extra_data")))


@query(WITH_LOGS + """, runs AS (SELECT 'glob' AS read_as, log_type FROM logs UNION ALL SELECT 'glob', log_type FROM logs
    WHERE log_type = 'ERROR' UNION ALL SELECT 'latest', log_type FROM logs WHERE log_type = 'ERROR'
    UNION ALL SELECT 'partitioned', log_type FROM logs WHERE k < 50)
  SELECT read_as, log_type, count(*) AS row_count FROM runs GROUP BY ALL""")
def stored_runs(spark, sf_dir):
    """Runs written twice, the second time over the first, and read by glob, newest run and partition."""
    root = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    rows = materialize(logs(spark, sf_dir).select("log_id", "log_type", "k"))
    sources.write_table(rows.filter("k < 10"), f"{root}/features_1")
    sources.write_table(rows, f"{root}/features_1")
    sources.write_table(rows.filter("k < 50"), f"{root}/by_type", ["log_type"])
    sources.write_table(rows.filter("log_type = 'ERROR'"), f"{root}/features_2")
    read = {"glob": sources.read_logs(spark, f"{root}/features_*"),
            "latest": sources.read_latest_run(spark, f"{root}/features_*"),
            "partitioned": sources.read_logs(spark, f"{root}/by_type")}
    parts = [df.select(F.lit(name).alias("read_as"), "log_type") for name, df in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("read_as", "log_type").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("SELECT event_id, CASE WHEN value >= 5 THEN ts END AS timestamp FROM events")
def parse_timestamps(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.when(F.col("value") < 5, "no time").otherwise(F.col("ts").cast("string")).alias("timestamp"))
    return sources.parse_timestamps(rows)


@query(WITH_LOGS + f""" SELECT log_id, CAST(hour(timestamp) AS INTEGER) AS hour,
  CAST(dayofweek(timestamp) + 1 AS INTEGER) AS day_of_week,
  CAST(CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CAST(CASE WHEN hour(timestamp) BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS INTEGER) AS is_business_hours,
  {_SEC} AS timestamp_unix, CAST(timestamp AS DATE) AS date FROM logs""")
def temporal_features(spark, sf_dir):
    return features.temporal_features(logs(spark, sf_dir)).select(
        "log_id", "hour", "day_of_week", "is_weekend", "is_business_hours",
        F.unix_timestamp("timestamp").alias("timestamp_unix"), F.to_date("timestamp").alias("date"))


@query(WITH_LOGS + """ SELECT log_id, CAST(CASE CASE WHEN k % 7 = 0 THEN 'TRACE' ELSE log_level END
  WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 END AS INTEGER)
  AS log_level_encoded FROM logs""")
def level_codes(spark, sf_dir):
    level = F.when(F.col("k") % 7 == 0, "TRACE").otherwise(F.col("log_level"))
    return logs(spark, sf_dir).select("log_id", fn.level_code(level).alias("log_level_encoded"))


@query(WITH_FEATURES + " SELECT log_id, log_type, log_level_encoded, log_type_indexed FROM features")
def encode_categories(spark, sf_dir):
    return features.encode_categories(logs(spark, sf_dir)).select(
        "log_id", "log_type", "log_level_encoded", "log_type_indexed")


@query(WITH_LOGS + r""", found AS (SELECT log_id, regexp_extract(message, '\b(\d{3})\b', 1) AS extracted_status_code
  FROM logs) SELECT *, CAST(CASE WHEN TRY_CAST(extracted_status_code AS INTEGER) >= 400 THEN 1 ELSE 0 END AS INTEGER)
  AS is_error_status FROM found""")
def status_features(spark, sf_dir):
    return enrich.status_features(logs(spark, sf_dir)).select("log_id", "extracted_status_code", "is_error_status")


@query(WITH_LOGS + """ SELECT log_id, user_id, coalesce(status_code, 0) AS status_code,
  round(coalesce(response_time_ms, 0.0), 6) AS response_time_ms,
  round(coalesce(execution_time_ms, 0.0), 6) AS execution_time_ms, is_anomaly FROM logs""")
def zero_fill(spark, sf_dir):
    return logs(spark, sf_dir).select("log_id", "user_id", "status_code", "response_time_ms", "execution_time_ms",
                                      "is_anomaly").fillna(0)


@query(WITH_LOGS + """ SELECT log_id, round(CASE WHEN log_type = 'API_REQUEST' THEN value END, 6) AS api_value FROM logs""")
def api_response_time(spark, sf_dir):
    return logs(spark, sf_dir).select("log_id", fn.api_response_time(F.col("log_type"), F.col("value")).alias("api_value"))


@query(WITH_FEATURES + """ SELECT log_id, round(m, 6) AS mean_response_time, round(s, 6) AS std_response_time,
  round(p95, 6) AS p95_response_time, round(response_time_zscore, 6) AS response_time_zscore, is_slow_response
  FROM features JOIN stats USING (log_type)""")
def statistical_features(spark, sf_dir):
    return features.statistical_features(logs(spark, sf_dir)).select(
        "log_id", "mean_response_time", "std_response_time", "p95_response_time", "response_time_zscore",
        "is_slow_response")


_VECTORS = [("forest", schemas.FOREST_FEATURES), ("sequence", schemas.SEQUENCE_FEATURES)]


@query(WITH_FEATURES + " SELECT log_id, " + ", ".join(
    f"round(coalesce(CAST({c} AS DOUBLE), 0.0), 6) AS {name}_{i}" for name, columns in _VECTORS
    for i, c in enumerate(columns)) + " FROM features")
def feature_vector(spark, sf_dir):
    """All inputs of both models, in their order."""
    rows = features.build_features(logs(spark, sf_dir))
    for name, columns in _VECTORS:
        rows = scoring.feature_vector(rows, columns, name)
    return rows.select("log_id", *[F.col(name)[i].alias(f"{name}_{i}") for name, columns in _VECTORS
                                   for i in range(len(columns))])


@query(WITH_LOGS + """, filled AS (SELECT log_id, CAST(hour(timestamp) AS DOUBLE) AS hour,
  coalesce(response_time_ms, 0.0) AS response_time_ms, 1.0 AS one FROM logs), stats AS (
  SELECT avg(hour) AS mh, stddev_pop(hour) AS sh, avg(response_time_ms) AS mr, stddev_pop(response_time_ms) AS sr
  FROM filled)
  SELECT log_id, round((hour - mh) / sh, 6) AS hour, round((response_time_ms - mr) / sr, 6) AS response_time_ms,
  CAST(0.0 AS DOUBLE) AS one FROM filled, stats""")
def standard_scaling(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumns({"hour": F.hour("timestamp"), "one": F.lit(1)})
    scaler = scoring.fit_scaler(rows, ["hour", "response_time_ms", "one"])
    return scoring.scale(rows, scaler, ["log_id"])


@query(WITH_LOGS + """ SELECT log_id, round(1 - (value - (SELECT min(value) FROM logs))
  / (SELECT max(value) - min(value) FROM logs), 6) AS score FROM logs""")
def min_max_inverted(spark, sf_dir):
    return scoring.min_max(logs(spark, sf_dir), "value", "score", invert=True).select("log_id", "score")


@query(WITH_LOGS + """ SELECT log_id, round((value - (SELECT min(value) FROM logs))
  / (SELECT max(value) - min(value) + 1e-8 FROM logs), 6) AS score FROM logs""")
def min_max_scores(spark, sf_dir):
    return scoring.min_max(logs(spark, sf_dir), "value", "score", epsilon=1e-8).select("log_id", "score")


# --- rolling, lags, enrichment ----------------------------------------------------------------------------

@query(WITH_FEATURES + """ SELECT log_id, count_5min, count_15min, count_1hour,
  round(avg_response_time_5min, 6) AS avg_response_time_5min, round(max_response_time_5min, 6) AS max_response_time_5min
  FROM features""")
def rolling_statistics(spark, sf_dir):
    return features.rolling_statistics(logs(spark, sf_dir)).select(
        "log_id", "count_5min", "count_15min", "count_1hour", "avg_response_time_5min", "max_response_time_5min")


@query(WITH_FEATURES + """ SELECT log_id, round(response_time_lag_1, 6) AS response_time_lag_1,
  round(response_time_lag_2, 6) AS response_time_lag_2, round(response_time_lag_3, 6) AS response_time_lag_3,
  count_lag_1, count_lag_2, count_lag_3 FROM features""")
def lag_features(spark, sf_dir):
    rolled = features.rolling_statistics(logs(spark, sf_dir))
    return features.sequence_features(rolled).select(
        "log_id", *[f"{c}_lag_{i}" for c in ("response_time", "count") for i in (1, 2, 3)])


@query(WITH_FEATURES + " " + _round_all("features", [
    "log_type_indexed", "avg_response_time_5min", "max_response_time_5min", "response_time_zscore",
    "response_time_lag_1", "response_time_lag_2", "response_time_lag_3", "response_time_ms"]))
def feature_table(spark, sf_dir):
    return features.build_features(logs(spark, sf_dir))


_ARRIVAL = f""", timed AS (SELECT *, {_SEC} AS sec FROM logs), arrived AS (
  SELECT *, lag(timestamp) OVER (PARTITION BY log_type ORDER BY timestamp, log_id) AS prev_timestamp,
    coalesce(sec - lag(sec) OVER (PARTITION BY log_type ORDER BY timestamp, log_id), 0) AS inter_arrival_seconds
  FROM timed)"""


@query(WITH_LOGS + _ARRIVAL + " SELECT log_id, prev_timestamp, inter_arrival_seconds FROM arrived")
def inter_arrival(spark, sf_dir):
    return enrich.inter_arrival(logs(spark, sf_dir)).select("log_id", "prev_timestamp", "inter_arrival_seconds")


_HOURLY = f""", counted AS (SELECT *, count(*) OVER h AS count_per_hour, var_samp(response_time_ms) OVER h AS v,
    avg(response_time_ms) OVER h AS m, count(log_level) OVER h AS known,
    {', '.join(f"count(*) FILTER (WHERE log_level = '{x}') OVER h AS l{i}" for i, x in enumerate(schemas.LOG_LEVELS))}
  FROM arrived WINDOW h AS ({_FRAME.format(3600)})), hourly AS (
  SELECT *, v AS variance_response_time, CASE WHEN m <> 0 THEN sqrt(v) / m ELSE 0.0 END AS coefficient_variation,
    {' + '.join(f"CASE WHEN l{i} > 0 THEN -(l{i} / known) * log2(l{i} / known) ELSE 0.0 END" for i in range(5))}
      AS log_level_entropy,
    sum(CASE WHEN log_level IS NOT NULL THEN log2(count_per_hour) / count_per_hour ELSE 0.0 END) OVER h
      AS log_level_entropy_literal
  FROM counted WINDOW h AS ({_FRAME.format(3600)}))"""


@query(WITH_LOGS + _ARRIVAL + _HOURLY + """ SELECT log_id, count_per_hour,
  round(variance_response_time, 7) AS variance_response_time, round(coefficient_variation, 7) AS coefficient_variation,
  round(log_level_entropy, 7) AS log_level_entropy, round(log_level_entropy_literal, 7) AS log_level_entropy_literal
  FROM hourly""", digits=7)
def hourly_variability(spark, sf_dir):
    return enrich.hourly_variability(logs(spark, sf_dir)).select(
        "log_id", "count_per_hour", "variance_response_time", "coefficient_variation", "log_level_entropy",
        "log_level_entropy_literal")


_BURST = """, recent AS (SELECT *, count(*) OVER (PARTITION BY log_type ORDER BY timestamp, log_id
    ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS recent_count FROM {}), burst AS (
  SELECT *, avg(recent_count) OVER (PARTITION BY log_type) AS avg_count,
    stddev_samp(recent_count) OVER (PARTITION BY log_type) AS std_count FROM recent), flagged AS (
  SELECT *, CAST(CASE WHEN recent_count > avg_count + 2.0 * std_count THEN 1 ELSE 0 END AS INTEGER) AS is_burst
  FROM burst)"""


@query(WITH_LOGS + _BURST.format("logs") + """ SELECT log_id, recent_count, round(avg_count, 6) AS avg_count,
  round(std_count, 6) AS std_count, is_burst FROM flagged""")
def row_bursts(spark, sf_dir):
    return enrich.row_bursts(logs(spark, sf_dir)).select("log_id", "recent_count", "avg_count", "std_count", "is_burst")


_TIME_BURST = f""", timed AS (SELECT *, {_SEC} AS sec FROM logs), recent AS (
  SELECT *, count(*) OVER ({_FRAME.format(300)}) AS recent_count FROM timed), burst AS (
  SELECT *, avg(recent_count) OVER (PARTITION BY log_type) AS avg_count,
    stddev_samp(recent_count) OVER (PARTITION BY log_type) AS std_count FROM recent), flagged AS (
  SELECT *, CAST(CASE WHEN recent_count > avg_count + 2.0 * std_count THEN 1 ELSE 0 END AS INTEGER) AS is_burst
  FROM burst)"""


@query(WITH_LOGS + _TIME_BURST + """ SELECT log_id, recent_count, round(avg_count, 6) AS avg_count,
  round(std_count, 6) AS std_count, is_burst FROM flagged""")
def time_bursts(spark, sf_dir):
    return enrich.time_bursts(logs(spark, sf_dir)).select("log_id", "recent_count", "avg_count", "std_count", "is_burst")


@query(WITH_LOGS + _TIME_BURST + " SELECT is_burst, count(*) AS count FROM flagged GROUP BY is_burst")
def burst_counts(spark, sf_dir):
    return reports.counts_by_flag(enrich.time_bursts(logs(spark, sf_dir)))


@query(WITH_LOGS + """ SELECT log_id, round(avg(value) OVER (PARTITION BY log_type), 6) AS value_mean,
  round(stddev_samp(value) OVER (PARTITION BY log_type), 6) AS value_std FROM logs""")
def group_spread(spark, sf_dir):
    return enrich.group_spread(logs(spark, sf_dir), "log_type", "value").select("log_id", "value_mean", "value_std")


@query(WITH_LOGS + _ARRIVAL + _HOURLY + _BURST.format("hourly") + r""" SELECT log_id, timestamp, log_type, log_level,
  user_id, status_code, message, regexp_extract(message, '\b(\d{3})\b', 1) AS extracted_status_code,
  CAST(CASE WHEN TRY_CAST(regexp_extract(message, '\b(\d{3})\b', 1) AS INTEGER) >= 400 THEN 1 ELSE 0 END AS INTEGER)
    AS is_error_status, prev_timestamp, inter_arrival_seconds, count_per_hour,
  round(variance_response_time, 7) AS variance_response_time, round(coefficient_variation, 7) AS coefficient_variation,
  round(log_level_entropy, 7) AS log_level_entropy, round(log_level_entropy_literal, 7) AS log_level_entropy_literal,
  recent_count, round(avg_count, 7) AS avg_count, round(std_count, 7) AS std_count, is_burst FROM flagged""", digits=7)
def enriched_logs(spark, sf_dir):
    return enrich.build_enriched(logs(spark, sf_dir)).drop(
        "k", "response_time_ms", "execution_time_ms", "is_anomaly", "event_id", "value")


@query(WITH_LOGS + """, ordered AS (SELECT *, row_number() OVER (ORDER BY timestamp, log_id) - 1 AS position,
    CAST(round(value * 100) AS BIGINT) AS cents FROM logs), framed AS (
  SELECT *, max(CAST(is_anomaly AS INTEGER)) OVER w AS sequence_label, count(*) OVER w AS steps,
    last_value(log_id) OVER w AS last_id, sum(cents * position) OVER w AS moment, sum(cents) OVER w AS total,
    sum(k * position) OVER w AS k_moment, sum(k) OVER w AS k_total
  FROM ordered WINDOW w AS (ORDER BY timestamp, log_id ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))
  SELECT position, log_id AS first_id, last_id, sequence_label, CAST(50 AS INTEGER) AS steps,
    CAST(moment - (position - 1) * total AS BIGINT) AS value_checksum,
    CAST(k_moment - (position - 1) * k_total AS BIGINT) AS k_checksum FROM framed WHERE steps = 50""")
def sequences(spark, sf_dir):
    """The steps go in as a sum that every step's place and value changes."""
    rows = logs(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100))
    found = sequence.sequences(rows, ["cents", "k"], 50)

    def checksum(column):
        places = F.transform("steps", lambda s, i: (i + 1) * s[column])
        return F.aggregate(places, F.lit(0.0), lambda a, x: a + x).cast("long")

    return found.withColumns({"value_checksum": checksum(0), "k_checksum": checksum(1), "steps": F.size("steps")})


# --- scores -----------------------------------------------------------------------------------------------

@query(WITH_SCORED + """ SELECT log_id, round(if_score, 6) AS if_score, round(combined_score, 6) AS combined_score,
  is_anomaly_predicted FROM scored""")
def combined_scores(spark, sf_dir):
    rows = logs(spark, sf_dir)
    scores = rows.filter("k >= 2").select(
        "log_id", F.least(F.col("value") / 200.0, F.lit(1.0)).alias("if_score"))
    return scoring.combine_scores(scoring.attach_scores(rows, scores)).select(
        "log_id", "if_score", "combined_score", "is_anomaly_predicted")


@query(WITH_LOGS + """, two AS (SELECT log_id, CASE WHEN k >= 2 THEN least(value / 200.0, 1.0) END AS a,
    CASE WHEN k % 3 > 0 THEN k / 100.0 END AS b FROM logs), mixed AS (SELECT log_id, CASE WHEN a IS NULL AND b IS NULL THEN 0.0
    WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (3 * a + b) / 4 END AS c FROM two)
  SELECT log_id, round(CAST(c AS DOUBLE), 9) AS combined_score, CAST(c > 0.3 AS INTEGER) AS is_anomaly_predicted FROM mixed""",
       digits=9)
def combined_two_models(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumns({
        "if_score": F.when(F.col("k") >= 2, F.least(F.col("value") / 200.0, F.lit(1.0))),
        "sequence_score": F.when(F.col("k") % 3 > 0, F.col("k") / 100.0)})
    return scoring.combine_scores(rows, {"if_score": 3.0, "sequence_score": 1.0}, 0.3).select(
        "log_id", "combined_score", "is_anomaly_predicted")


@query(WITH_SCORED + """ SELECT log_id, timestamp, log_type, message, round(combined_score, 6) AS combined_score,
  is_anomaly_predicted, is_anomaly_actual FROM scored""")
def result_table(spark, sf_dir):
    return scoring.result_columns(scored_logs(spark, sf_dir).drop("is_anomaly_actual"))


@query(WITH_SCORED + """ SELECT log_id, timestamp, log_level, log_type, message, round(combined_score, 6)
  AS anomaly_score, 'ensemble' AS model_name, 'v1.0' AS model_version, '{}' AS features FROM scored
  WHERE is_anomaly_predicted = 1""")
def anomaly_rows(spark, sf_dir):
    return scoring.anomaly_rows(scored_logs(spark, sf_dir))


@query(WITH_SCORED + """, cut AS (SELECT quantile_cont(-combined_score, 0.05) AS c FROM scored)
  SELECT log_id, CAST(CASE WHEN -combined_score - c < 0 THEN 1 ELSE 0 END AS INTEGER) AS if_prediction
  FROM scored, cut""")
def contamination_flags(spark, sf_dir):
    scored = materialize(scored_logs(spark, sf_dir).select("log_id", (-F.col("combined_score")).alias("raw")))
    cut = exact_quantile(scored, "raw", 0.05, name="cut").first()["cut"]
    return scored.select("log_id", scoring.prediction_from_decision(F.col("raw") - cut).alias("if_prediction"))


@query(WITH_SCORED + """ SELECT log_type, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_disc(value, 0.95), 6) AS p95_discrete FROM scored GROUP BY log_type""")
def exact_percentiles(spark, sf_dir):
    rows = materialize(logs(spark, sf_dir).select("log_type", "value"))
    return exact_quantile(rows, "value", 0.95, ["log_type"], "p95").join(
        exact_quantile(rows, "value", 0.95, ["log_type"], "p95_discrete", discrete=True), "log_type")


@query(WITH_SCORED + """ SELECT log_id, timestamp, log_type, message, round(combined_score, 6) AS combined_score
  FROM scored WHERE is_anomaly_predicted = 1 ORDER BY scored.combined_score DESC, log_id LIMIT 10""")
def top_anomalies(spark, sf_dir):
    return scoring.top_anomalies(scored_logs(spark, sf_dir))


@query(WITH_SCORED + """ SELECT count(*) AS total, CAST(sum(is_anomaly_predicted) AS BIGINT) AS anomalies,
  round(sum(is_anomaly_predicted) * 100.0 / count(*), 6) AS anomaly_percent FROM scored""")
def run_summary(spark, sf_dir):
    return scoring.run_summary(scored_logs(spark, sf_dir))


_COUNTS = """count(*) FILTER (WHERE is_anomaly_actual AND is_anomaly_predicted = 1) AS tp,
  count(*) FILTER (WHERE NOT is_anomaly_actual AND is_anomaly_predicted = 1) AS fp,
  count(*) FILTER (WHERE is_anomaly_actual AND is_anomaly_predicted = 0) AS fn,
  count(*) FILTER (WHERE NOT is_anomaly_actual AND is_anomaly_predicted = 0) AS tn"""


@query(WITH_SCORED + f""", c AS (SELECT log_type, {_COUNTS}, count(*) AS dataset_size FROM scored GROUP BY log_type)
  SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1_score FROM c""")
def evaluation(spark, sf_dir):
    return evaluate.evaluate(scored_logs(spark, sf_dir), by=["log_type"])


@query(WITH_SCORED + f""", c AS (SELECT {_COUNTS} FROM scored)
  SELECT 0 AS actual, 0 AS predicted, tn AS count FROM c UNION ALL SELECT 0, 1, fp FROM c
  UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c""")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(scored_logs(spark, sf_dir))


@query(WITH_LOGS + """, history AS (SELECT log_type, hour(timestamp) AS season, avg(value) AS m, stddev_samp(value) AS s
  FROM logs GROUP BY ALL)
  SELECT log_id, coalesce(CASE WHEN s = 0 THEN false ELSE abs((value - m) / s) > 3.0 END, false) AS is_seasonal_anomaly
  FROM logs JOIN history ON logs.log_type = history.log_type AND hour(timestamp) = season""")
def seasonal_anomalies(spark, sf_dir):
    return detectors.seasonal_anomalies(logs(spark, sf_dir), "value", F.hour("timestamp")).select(
        "log_id", "is_seasonal_anomaly")


@query(WITH_LOGS + """, c AS (SELECT user_id, log_level, count(*) AS n FROM logs WHERE user_id IS NOT NULL GROUP BY ALL),
  p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
  SELECT user_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY user_id""")
def level_entropy(spark, sf_dir):
    counts = logs(spark, sf_dir).filter("user_id IS NOT NULL").groupBy("user_id").agg(
        *[F.count_if(F.col("log_level") == x).alias(x) for x in schemas.LOG_LEVELS], F.count(F.lit(1)).alias("n"))
    return counts.select(
        "user_id", (F.round(fn.entropy_bits([F.col(x) for x in schemas.LOG_LEVELS], F.col("n")), 6) + 0.0).alias("entropy"))


@query(r""" WITH words AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
  each AS (SELECT conv_id, turn, unnest(w) AS word FROM words), c AS (
  SELECT conv_id, turn, word, count(*) AS n FROM each GROUP BY ALL), p AS (
  SELECT conv_id, turn, n / sum(n) OVER (PARTITION BY conv_id, turn) AS p FROM c)
  SELECT conv_id, turn, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY ALL""")
def array_entropy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text IS NOT NULL")
    entropy = fn.array_entropy_bits(F.split("text", " ", -1))
    return rows.select("conv_id", "turn", (F.round(entropy, 6) + 0.0).alias("entropy"))


# --- summaries and reports --------------------------------------------------------------------------------

_SUMMARY = """SELECT date_trunc('hour', timestamp) AS window_start,
  date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS window_end, log_type, count(*) AS log_count,
  round(avg(combined_score), 9) AS avg_anomaly_score, round(max(combined_score), 9) AS max_anomaly_score,
  CAST(sum(is_anomaly_predicted) AS BIGINT) AS anomaly_count, count(DISTINCT user_id) AS unique_users
  FROM scored GROUP BY ALL"""


@query(f"{WITH_SCORED} {_SUMMARY}", digits=9)
def hourly_summary(spark, sf_dir):
    return summary.hourly_summary(scored_logs(spark, sf_dir))


@query(f"{WITH_SCORED} {_SUMMARY} ORDER BY max(scored.combined_score) DESC, window_start, log_type LIMIT 10", digits=9)
def top_windows(spark, sf_dir):
    return summary.top_windows(summary.hourly_summary(scored_logs(spark, sf_dir)))


@query(WITH_LOGS + """ SELECT count(*) AS rows, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
  round(avg(CAST(is_anomaly AS INTEGER)) * 100, 6) AS anomaly_rate_percent FROM logs""")
def overview(spark, sf_dir):
    return reports.overview(logs(spark, sf_dir))


@query(WITH_LOGS + " SELECT log_type, count(*) AS count FROM logs GROUP BY log_type")
def type_counts(spark, sf_dir):
    return reports.value_counts(logs(spark, sf_dir), "log_type")


@query(WITH_LOGS + " SELECT log_level, count(*) AS count FROM logs GROUP BY log_level")
def level_counts(spark, sf_dir):
    return reports.value_counts(logs(spark, sf_dir), "log_level")


@query(WITH_ANOMALIES + " SELECT model_name, count(*) AS count FROM anomalies GROUP BY model_name")
def model_counts(spark, sf_dir):
    return reports.value_counts(anomaly_table(spark, sf_dir), "model_name")


@query(WITH_LOGS + " SELECT is_anomaly, count(*) AS count FROM logs GROUP BY is_anomaly")
def label_counts(spark, sf_dir):
    return reports.value_counts(logs(spark, sf_dir), "is_anomaly")


@query(WITH_LOGS + " SELECT CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS count FROM logs GROUP BY ALL")
def volume_by_hour(spark, sf_dir):
    return reports.volume_by_hour(logs(spark, sf_dir))


@query(WITH_LOGS + """ SELECT CAST(timestamp AS DATE) AS date, count(log_id) AS total_logs,
  count(*) FILTER (WHERE is_anomaly) AS anomalies FROM logs GROUP BY ALL""")
def daily_volume(spark, sf_dir):
    return reports.daily_volume(logs(spark, sf_dir))


@query(WITH_LOGS + """, api AS (SELECT is_anomaly, response_time_ms AS v FROM logs WHERE log_type = 'API_REQUEST'),
  r AS (SELECT is_anomaly, min(v) AS lo, max(v) AS hi FROM api GROUP BY is_anomaly), b AS (
  SELECT api.is_anomaly, lo, (hi - lo) / 50 AS w,
    CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INTEGER) AS bin
  FROM api JOIN r USING (is_anomaly))
  SELECT is_anomaly, bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end,
    count(*) AS count FROM b GROUP BY ALL""")
def response_time_histogram(spark, sf_dir):
    api = logs(spark, sf_dir).filter("log_type = 'API_REQUEST'")
    return reports.histogram(api, "response_time_ms", 50, "is_anomaly")


@query(WITH_ANOMALIES + """, r AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM anomalies), b AS (
  SELECT lo, (hi - lo) / 30 AS w, CAST(least(floor((anomaly_score - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin
  FROM anomalies, r)
  SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count(*) AS count
  FROM b GROUP BY ALL""")
def score_histogram(spark, sf_dir):
    return reports.histogram(anomaly_table(spark, sf_dir), "anomaly_score", 30)


@query(WITH_LOGS + """, api AS (SELECT is_anomaly, response_time_ms AS v FROM logs WHERE log_type = 'API_REQUEST'),
  q AS (SELECT is_anomaly, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM api GROUP BY is_anomaly), s AS (
  SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM api JOIN q USING (is_anomaly))
  SELECT is_anomaly, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    round(min(v) FILTER (WHERE inside), 6) AS whisker_low, round(max(v) FILTER (WHERE inside), 6) AS whisker_high,
    count(*) FILTER (WHERE NOT inside) AS outliers FROM s GROUP BY is_anomaly, q.q1, q.median, q.q3""".replace("q.q1, q.median, q.q3", "s.q1, s.median, s.q3"))
def response_time_box(spark, sf_dir):
    api = logs(spark, sf_dir).filter("log_type = 'API_REQUEST'")
    return reports.box_statistics(api, "response_time_ms", "is_anomaly")


@query(WITH_PERFORMANCE + """, p AS (SELECT model_name, metric_name, max_by(metric_value, evaluation_date) AS v
  FROM performance GROUP BY ALL)
  SELECT model_name, round(max(v) FILTER (WHERE metric_name = 'precision'), 6) AS precision,
    round(max(v) FILTER (WHERE metric_name = 'recall'), 6) AS recall,
    round(max(v) FILTER (WHERE metric_name = 'f1_score'), 6) AS f1_score FROM p GROUP BY model_name""")
def metric_comparison(spark, sf_dir):
    return reports.metric_comparison(performance_table(spark, sf_dir), ["precision", "recall", "f1_score"])


@query(WITH_PERFORMANCE + " SELECT model_name, metric_name, round(metric_value, 6) AS metric_value, evaluation_date"
       " FROM performance")
def metric_history(spark, sf_dir):
    return reports.metric_history(performance_table(spark, sf_dir))


@query(WITH_ANOMALIES + """ SELECT timestamp, log_type, round(anomaly_score, 6) AS anomaly_score, message FROM anomalies
  ORDER BY anomalies.anomaly_score DESC, log_id LIMIT 10""")
def largest_scores(spark, sf_dir):
    return reports.largest(anomaly_table(spark, sf_dir), "anomaly_score", 10,
                           ["timestamp", "log_type", "anomaly_score", "message"], "log_id")


# --- result tables ----------------------------------------------------------------------------------------

@query(WITH_ANOMALIES + """, stored AS (SELECT * FROM anomalies WHERE timestamp < TIMESTAMP '2024-01-20'),
  batch AS (SELECT * REPLACE (combined_score * 0.9 AS combined_score) FROM scored
  WHERE is_anomaly_predicted = 1 AND timestamp >= TIMESTAMP '2024-01-10'), merged AS (
  SELECT a.id, a.log_id, a.timestamp, a.log_level, a.log_type, a.message,
    coalesce(b.combined_score, a.anomaly_score) AS anomaly_score,
    CASE WHEN b.log_id IS NULL THEN a.model_name ELSE 'ensemble' END AS model_name,
    CASE WHEN b.log_id IS NULL THEN a.model_version ELSE 'v1.1' END AS model_version, a.features, a.detected_at,
    a.is_confirmed, a.feedback, a.notes
  FROM stored a LEFT JOIN batch b ON a.log_id = b.log_id
  UNION ALL
  SELECT (SELECT count(*) FROM stored) + row_number() OVER (ORDER BY timestamp, log_id), log_id, timestamp, log_level,
    log_type, message, combined_score, 'ensemble', 'v1.1', '{}', timestamp, false, NULL, NULL
  FROM batch WHERE log_id NOT IN (SELECT log_id FROM stored))
  SELECT * REPLACE (round(anomaly_score, 6) AS anomaly_score) FROM merged""")
def upsert_anomalies(spark, sf_dir):
    """Days 1 to 19, then a second run over day 10 and later with other scores."""
    found = anomaly_batch(scored_logs(spark, sf_dir))
    stored = results.upsert_anomalies(empty(spark, schemas.ANOMALIES), found.filter("timestamp < '2024-01-20'"))
    batch = found.filter("timestamp >= '2024-01-10'").withColumns({
        "anomaly_score": F.col("anomaly_score") * 0.9, "model_version": F.lit("v1.1")})
    copies = batch.withColumn("anomaly_score", F.col("anomaly_score") / 2)  # the greater score of each pair counts
    return results.upsert_anomalies(stored, batch.unionByName(copies))


@query(WITH_SCORED + f""", c AS (SELECT CAST(timestamp >= TIMESTAMP '2024-01-16' AS INTEGER) AS half, {_COUNTS}, count(*) AS n FROM scored GROUP BY 1), m AS (
  SELECT half, n, 'precision' AS metric_name, tp / (tp + fp) AS v FROM c
  UNION ALL SELECT half, n, 'recall', tp / (tp + fn) FROM c
  UNION ALL SELECT half, n, 'f1_score', 2 * tp / (2 * tp + fp + fn) FROM c)
  SELECT row_number() OVER (ORDER BY half, metric_name) AS id, 'isolation_forest' AS model_name, 'v1.0' AS model_version,
    metric_name, round(v, 6) AS metric_value, DATE '2024-01-30' + CAST(half AS INTEGER) AS evaluation_date,
    n AS dataset_size FROM m""")
def record_metrics(spark, sf_dir):
    table = empty(spark, schemas.MODEL_PERFORMANCE)
    late = F.col("timestamp") >= F.lit("2024-01-16").cast("timestamp_ntz")
    for half, date in ((~late, "2024-01-30"), (late, "2024-01-31")):
        rows = scored_logs(spark, sf_dir).filter(half)
        table = results.record_metrics(table, evaluate.metric_rows(evaluate.evaluate(rows)), "isolation_forest", "v1.0",
                                       F.to_date(F.lit(date)))
    return table.drop("notes", "created_at")


_STAT_PARTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature_name, stat_type, round(stat_value, 6) AS stat_value, n AS sample_size FROM (
  SELECT count(*) AS n, unnest(['mean', 'std', 'min', 'max', 'percentile_95']) AS stat_type, unnest([avg({c}),
  stddev_samp({c}), min({c}), max({c}), quantile_disc({c}, 0.95)]) AS stat_value FROM doubles)"""
    for c in ("value", "response_time_ms", "k"))
WITH_STATISTICS = WITH_LOGS + f""", doubles AS (SELECT value, response_time_ms, CAST(k AS DOUBLE) AS k FROM logs),
  statistics AS ({_STAT_PARTS})"""


@query(WITH_STATISTICS + " SELECT * FROM statistics")
def feature_statistics(spark, sf_dir):
    return monitor.feature_statistics(logs(spark, sf_dir), ["value", "response_time_ms", "k"])


@query(WITH_STATISTICS + """ SELECT row_number() OVER (ORDER BY feature_name || '/' || stat_type) AS id, feature_name,
  stat_type, stat_value, DATE '2024-01-31' AS calculation_date, sample_size FROM statistics""")
def record_feature_statistics(spark, sf_dir):
    rows = monitor.feature_statistics(logs(spark, sf_dir), ["value", "response_time_ms", "k"])
    return results.record_feature_statistics(
        empty(spark, schemas.FEATURE_STATISTICS), rows, F.to_date(F.lit("2024-01-31"))).drop("created_at")


@query(WITH_NEW_ALERTS + " SELECT * FROM new_alerts")
def create_alerts(spark, sf_dir):
    return results.create_alerts(empty(spark, schemas.ALERTS), anomaly_table(spark, sf_dir)).drop(
        "acknowledged_at", "resolved_at")


@query(WITH_ALERTS + " SELECT * FROM alerts")
def alert_lifecycle(spark, sf_dir):
    return alert_table(spark, sf_dir)


@query(WITH_ALERTS + """ SELECT id, anomaly_id, severity, status FROM alerts WHERE anomaly_id NOT IN (
  SELECT id FROM anomalies WHERE log_type <> 'API_REQUEST')""")
def orphan_alerts(spark, sf_dir):
    known = anomaly_table(spark, sf_dir).filter("log_type <> 'API_REQUEST'")
    return results.orphan_alerts(alert_table(spark, sf_dir), known).select("id", "anomaly_id", "severity", "status")


@query(WITH_ALERTS + f""" SELECT a.id, a.timestamp, a.log_type, a.message, round(a.anomaly_score, 6) AS anomaly_score,
  a.model_name, al.severity, al.status FROM anomalies a JOIN alerts al ON a.id = al.anomaly_id
  WHERE al.severity IN ('high', 'critical') AND al.status = 'open'
    AND a.detected_at > TIMESTAMP '{AS_OF}' - INTERVAL 240 HOURS""")
def recent_critical_anomalies(spark, sf_dir):
    return results.recent_critical_anomalies(anomaly_table(spark, sf_dir), alert_table(spark, sf_dir), as_of(), hours=240)


@query(WITH_ANOMALIES + f""" SELECT id, log_id, timestamp, log_type, message, round(anomaly_score, 6) AS anomaly_score,
  model_name, detected_at FROM anomalies WHERE detected_at > TIMESTAMP '{AS_OF}' - INTERVAL 240 HOURS
  AND anomalies.anomaly_score >= 0.7 ORDER BY anomalies.anomaly_score DESC, log_id LIMIT 100""")
def recent_anomalies(spark, sf_dir):
    return results.recent_anomalies(anomaly_table(spark, sf_dir), as_of(), hours=240, min_score=0.7)


@query(WITH_ANOMALIES + """ SELECT log_type, count(*) AS n, round(max(anomaly_score), 6) AS top FROM anomalies
  WHERE anomaly_score > 0.8 GROUP BY log_type""")
def ad_hoc_sql(spark, sf_dir):
    return results.run_sql(
        spark, "SELECT log_type, count(*) AS n, max(anomaly_score) AS top FROM anomalies"
               " WHERE anomaly_score > :low GROUP BY log_type",
        {"anomalies": anomaly_table(spark, sf_dir)}, {"low": 0.8})


@query(WITH_ANOMALIES + """ SELECT id, log_id, round(anomaly_score, 6) AS anomaly_score, CASE WHEN log_type = 'ERROR'
  THEN 'reviewed' END AS notes FROM anomalies""")
def update_rows(spark, sf_dir):
    table, _ = results.update_rows(anomaly_table(spark, sf_dir), F.col("log_type") == "ERROR",
                                   {"notes": F.lit("reviewed")})
    return table.select("id", "log_id", "anomaly_score", "notes")


@query(WITH_ANOMALIES + f""" SELECT id, log_id, detected_at FROM anomalies
  WHERE detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAYS""")
def retention(spark, sf_dir):
    return results.retain(anomaly_table(spark, sf_dir), "detected_at", as_of(), 10).select("id", "log_id", "detected_at")


@query(WITH_LOGS + """, daily AS (SELECT log_type, CAST(timestamp AS DATE) AS calculation_date, count(*) AS sample_size,
    avg(value) AS stat_value FROM logs GROUP BY ALL)
  SELECT row_number() OVER (ORDER BY calculation_date, log_type) AS id, log_type AS feature_name, calculation_date, sample_size,
    round(stat_value, 6) AS stat_value FROM daily QUALIFY calculation_date >= DATE '2024-01-11'""")
def statistics_retention(spark, sf_dir):
    """Daily statistics appended to their table, then all but the last twenty days dropped."""
    daily = logs(spark, sf_dir).groupBy("log_type", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg("value").alias("stat_value"))
    rows = daily.withColumns({"feature_name": F.col("log_type"), "stat_type": F.lit("mean"), "calculation_date": F.col("day"),
                              "created_at": F.col("day").cast("timestamp_ntz")})
    table = results.append_rows(empty(spark, schemas.FEATURE_STATISTICS), rows, schemas.FEATURE_STATISTICS, "created_at",
                                "feature_name")
    return results.retain(table, "calculation_date", as_of(), 20).select(
        "id", "feature_name", "calculation_date", "sample_size", "stat_value")


@query(WITH_ANOMALIES + """, reviews AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'true_positive' WHEN id % 3 = 0
  THEN 'false_positive' END AS verdict FROM anomalies)
  SELECT model_name, count(*) FILTER (WHERE verdict = 'true_positive') AS true_positives,
    count(*) FILTER (WHERE verdict = 'false_positive') AS false_positives,
    round(count(*) FILTER (WHERE verdict = 'true_positive') / count(verdict), 6) AS precision
  FROM reviews GROUP BY model_name""")
def reviewer_feedback(spark, sf_dir):
    table = anomaly_table(spark, sf_dir)
    verdict = F.when(F.col("id") % 2 == 0, "true_positive").when(F.col("id") % 3 == 0, "false_positive").otherwise("maybe")
    reviews = table.select("log_id", verdict.alias("feedback"), F.lit("checked").alias("notes"))
    return results.feedback_precision(results.apply_feedback(table, reviews))


@query(WITH_ANOMALIES + """ SELECT '2024-01-15' AS batch_id, count(*) AS total_logs, min(timestamp) AS start_timestamp,
  max(timestamp) AS end_timestamp FROM anomalies WHERE CAST(detected_at AS DATE) = DATE '2024-01-15'""")
def daily_report(spark, sf_dir):
    return results.daily_report(anomaly_table(spark, sf_dir), "2024-01-15")


# --- monitoring -------------------------------------------------------------------------------------------

@query(WITH_LOGS + """ SELECT 'not_empty' AS check_name, count(*) AS observed, count(*) > 0 AS passed FROM logs
  UNION ALL SELECT 'unique_log_id', count(*) - count(DISTINCT log_id), count(*) = count(DISTINCT log_id) FROM logs
  UNION ALL SELECT 'timestamp_present', count(*) - count(timestamp), count(*) = count(timestamp) FROM logs""")
def quality_checks(spark, sf_dir):
    return monitor.quality_checks(logs(spark, sf_dir))


@query(WITH_PERFORMANCE + f""" SELECT model_name, metric_name, round(metric_value, 6) AS metric_value, evaluation_date
  FROM performance WHERE evaluation_date > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS""")
def recent_metrics(spark, sf_dir):
    return monitor.recent_metrics(performance_table(spark, sf_dir), as_of())


@query(WITH_PERFORMANCE + f""" SELECT model_name, metric_name, round(metric_value, 6) AS metric_value, evaluation_date
  FROM performance WHERE evaluation_date > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND metric_name = 'f1_score'
  AND performance.metric_value < 0.7""")
def quality_warnings(spark, sf_dir):
    return monitor.quality_warnings(performance_table(spark, sf_dir), as_of())


@query(WITH_LOGS + """, halves AS (SELECT timestamp < TIMESTAMP '2024-01-16' AS early, value, CAST(k AS DOUBLE) AS k FROM logs),
  s AS (SELECT early, 'value' AS feature_name, avg(value) AS m, stddev_samp(value) AS s FROM halves GROUP BY early
  UNION ALL SELECT early, 'k', avg(k), stddev_samp(k) FROM halves GROUP BY early)
  SELECT a.feature_name, round(a.m, 6) AS previous_mean, round(a.s, 6) AS previous_std, round(b.m, 6) AS current_mean,
    round(b.s, 6) AS current_std, round((b.m - a.m) / abs(a.m), 6) AS relative_change,
    round((b.m - a.m) / a.s, 6) AS shift, abs((b.m - a.m) / a.s) > 0.5 AS drifted
  FROM s a JOIN s b ON a.feature_name = b.feature_name AND a.early AND NOT b.early""")
def feature_drift(spark, sf_dir):
    rows = logs(spark, sf_dir)
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz")
    return monitor.drift(monitor.feature_statistics(rows.filter(early), ["value", "k"]),
                         monitor.feature_statistics(rows.filter(~early), ["value", "k"]))


_SIDES = """, sides AS (SELECT timestamp < TIMESTAMP '2024-01-16' AS early, unnest(['value', 'k', 'response_time_ms']) AS feature_name,
    unnest([value, CAST(k AS DOUBLE), response_time_ms]) AS x FROM logs), kept AS (SELECT * FROM sides WHERE x IS NOT NULL),
  per_value AS (SELECT feature_name, x, count(*) FILTER (WHERE early) AS b, count(*) FILTER (WHERE NOT early) AS a
    FROM kept GROUP BY ALL), sums AS (
  SELECT *, sum(b) OVER w AS cb, sum(a) OVER w AS ca, sum(b) OVER (PARTITION BY feature_name) AS nb,
    sum(a) OVER (PARTITION BY feature_name) AS na FROM per_value WINDOW w AS (PARTITION BY feature_name ORDER BY x)),
  ks AS (SELECT feature_name, CAST(max(nb) AS BIGINT) AS previous_rows, CAST(max(na) AS BIGINT) AS current_rows,
    max(abs(cb / nb - ca / na)) AS ks FROM sums GROUP BY feature_name),
  edges AS (SELECT feature_name, unnest(list_distinct(quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e
    FROM kept WHERE early GROUP BY feature_name),
  binned AS (SELECT v.feature_name, x, any_value(b) AS b, any_value(a) AS a, count(e) AS bin FROM per_value v LEFT JOIN edges d
    ON v.feature_name = d.feature_name AND e < x GROUP BY ALL),
  shares AS (SELECT feature_name, greatest(sum(b) / sum(sum(b)) OVER (PARTITION BY feature_name), 0.0001) AS p,
    greatest(sum(a) / sum(sum(a)) OVER (PARTITION BY feature_name), 0.0001) AS q FROM binned GROUP BY feature_name, bin),
  psi AS (SELECT feature_name, sum((q - p) * ln(q / p)) AS psi FROM shares GROUP BY feature_name)"""


@query(WITH_LOGS + _SIDES + """ SELECT feature_name, previous_rows, current_rows, round(ks, 6) AS ks, round(psi, 6) AS psi,
  ks > 0.1 OR psi > 0.2 AS drifted FROM ks JOIN psi USING (feature_name)""")
def distribution_drift(spark, sf_dir):
    rows = logs(spark, sf_dir)
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz")
    return drift.distribution_drift(rows.filter(early), rows.filter(~early), ["value", "k", "response_time_ms"])


_P0 = "CASE WHEN {k} <= 49.5 THEN CASE WHEN {v} <= 20.25 THEN 9.5 ELSE 7.25 END WHEN {v} <= 150 THEN 6.0 ELSE 2.5 END"
_P1 = "CASE WHEN {v} <= 75 THEN 8.0 WHEN {k} <= 89 THEN 5.0 ELSE 2.0 END"
_DECIDED = (f"CAST(-pow(2, -(CAST({_P0} AS DOUBLE) + CAST({_P1} AS DOUBLE)) / 2 / (2 * (ln(255) + 0.5772156649015329) "
            "- 2 * 255 / 256)) + 0.55 < 0 AS INTEGER)")


@query(WITH_LOGS + f""", base AS (SELECT log_id, is_anomaly, k, value, row_number() OVER (ORDER BY md5('rows/' || log_id)) AS n,
    row_number() OVER (ORDER BY md5('k/' || log_id)) AS nk, row_number() OVER (ORDER BY md5('value/' || log_id)) AS nv FROM logs),
  dealt AS (SELECT a.is_anomaly, a.k, a.value, b.k AS pk, c.value AS pv FROM base a JOIN base b ON a.n = b.nk JOIN base c ON a.n = c.nv),
  decided AS (SELECT is_anomaly, unnest(['', 'k', 'value']) AS feature_name, unnest([{_DECIDED.format(k='k', v='value')},
    {_DECIDED.format(k='pk', v='value')}, {_DECIDED.format(k='k', v='pv')}]) AS p FROM dealt),
  f AS (SELECT feature_name, 2.0 * count(*) FILTER (WHERE is_anomaly AND p = 1) / (count(*) FILTER (WHERE is_anomaly)
    + count(*) FILTER (WHERE p = 1)) AS f1 FROM decided GROUP BY feature_name)
  SELECT a.feature_name, round(CAST(b.f1 AS DOUBLE), 6) AS f1_score, round(CAST(a.f1 AS DOUBLE), 6) AS permuted_f1_score,
    round(CAST(b.f1 - a.f1 AS DOUBLE), 6) AS loss FROM f a JOIN f b ON a.feature_name <> '' AND b.feature_name = ''""")
def permutation_importance(spark, sf_dir):
    """What the fixed forest loses when one of its two features is shuffled."""
    def predict(rows):
        return forest.score_forest(rows, fixed_forest(), relative_to_training=True).withColumnRenamed(
            "if_prediction", "prediction")

    return monitor.permutation_importance(logs(spark, sf_dir), ["k", "value"], predict, "is_anomaly")


@query(WITH_LOGS + """ SELECT CAST(timestamp AS DATE) AS date, log_type, count(*) AS row_count,
  round(avg(response_time_ms), 6) AS value_mean, count(DISTINCT user_id) AS exact_users, true AS users_within_bound,
  true AS quantile_within_bound FROM logs GROUP BY ALL""")
def sketch_ranges(spark, sf_dir):
    """Daily summaries merged from a stored table of hourly sketches, held against the exact values."""
    rows = logs(spark, sf_dir)
    hourly = materialize(sketches.sketch_table(rows))
    day = {"date": F.to_date("hour"), "log_type": F.col("log_type")}
    found = sketches.estimates(sketches.merged(hourly, day))
    named = rows.select(F.to_date("timestamp").alias("date"), "log_type", "user_id", "response_time_ms")
    beside = named.join(F.broadcast(found.select("date", "log_type", "value_quantile")), ["date", "log_type"])
    x, q = F.col("response_time_ms"), F.col("value_quantile")
    exact = beside.groupBy("date", "log_type").agg(
        F.count_distinct("user_id").alias("exact_users"), F.count(x).alias("_n"), F.count_if(x < q).alias("_below"),
        F.count_if(x <= q).alias("_upto"))
    slack = F.col("_n") * sketches.RANK_ERROR + 1
    rank = 0.95 * F.col("_n")
    quantile = (F.col("_n") == 0) | ((F.col("_below") - slack <= rank) & (rank <= F.col("_upto") + slack))
    users = F.abs(F.col("distinct_users") - F.col("exact_users")) <= 1 + sketches.USER_ERROR * F.col("exact_users")
    return found.join(exact, ["date", "log_type"]).select(
        "date", "log_type", "row_count", "value_mean", "exact_users", users.alias("users_within_bound"),
        quantile.alias("quantile_within_bound"))


@query(WITH_SCORED + """ SELECT 'value' AS feature_name, round(corr(value, combined_score), 6) AS correlation FROM scored
  UNION ALL SELECT 'k', round(corr(k, combined_score), 6) FROM scored""")
def feature_effect(spark, sf_dir):
    return monitor.feature_effect(scored_logs(spark, sf_dir), ["value", "k"], "combined_score")


# --- further detectors ------------------------------------------------------------------------------------

@query(WITH_LOGS + """, s AS (SELECT log_type, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.99) AS p
  FROM logs GROUP BY log_type)
  SELECT log_id, round((value - m) / s, 6) AS value_zscore,
    CAST(abs((value - m) / s) > 3.0 AS INTEGER) AS is_z_anomaly, CAST(value > p AS INTEGER) AS is_percentile_anomaly,
    CAST(abs((value - m) / s) > 3.0 OR value > p AS INTEGER) AS is_statistical_anomaly FROM logs JOIN s USING (log_type)""")
def statistical_detector(spark, sf_dir):
    return detectors.statistical_detector(logs(spark, sf_dir), "value").select(
        "log_id", "value_zscore", "is_z_anomaly", "is_percentile_anomaly", "is_statistical_anomaly")


_GRID = ", ".join(
    f"""count(*) OVER w{m} AS count_{m}min, round(avg(value) OVER w{m}, 6) AS mean_{m}min,
  round(stddev_samp(value) OVER w{m}, 6) AS std_{m}min, round(min(value) OVER w{m}, 6) AS min_{m}min,
  round(max(value) OVER w{m}, 6) AS max_{m}min""" for m in (5, 15, 30, 60))
_GRID_WINDOWS = ", ".join(f"w{m} AS ({_FRAME.format(m * 60)})" for m in (5, 15, 30, 60))


@query(WITH_LOGS + f""", timed AS (SELECT *, {_SEC} AS sec FROM logs)
  SELECT log_id, {_GRID} FROM timed WINDOW {_GRID_WINDOWS}""")
def rolling_grid(spark, sf_dir):
    grid = [f"{stat}_{m}min" for m in (5, 15, 30, 60) for stat in ("count", "mean", "std", "min", "max")]
    return detectors.rolling_grid(logs(spark, sf_dir), "value").select("log_id", *grid)


@query(WITH_LOGS.replace("WITH", "WITH RECURSIVE", 1) + """, s AS MATERIALIZED (SELECT log_id, log_type, response_time_ms AS x,
    row_number() OVER (PARTITION BY log_type ORDER BY timestamp, log_id) AS i
  FROM logs WHERE response_time_ms IS NOT NULL), r AS (SELECT log_id, log_type, i, x AS y FROM s WHERE i = 1
  UNION ALL SELECT s.log_id, s.log_type, s.i, 0.3 * s.x + 0.7 * r.y FROM r JOIN s ON s.log_type = r.log_type AND s.i = r.i + 1)
  SELECT log_id, round(y, 6) AS ewma FROM r UNION ALL SELECT log_id, NULL FROM logs WHERE response_time_ms IS NULL""")
def response_time_ewma(spark, sf_dir):
    return detectors.ewma(logs(spark, sf_dir)).select("log_id", "ewma")


@query(WITH_LOGS + """, gaps AS (SELECT user_id, timestamp, is_anomaly, CASE WHEN timestamp - lag(timestamp) OVER (
    PARTITION BY user_id ORDER BY timestamp) > INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS fresh FROM logs
  WHERE user_id IS NOT NULL), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY timestamp) AS session FROM gaps)
  SELECT user_id, min(timestamp) AS session_start, max(timestamp) AS session_end, count(*) AS log_count,
    count(*) FILTER (WHERE is_anomaly) AS anomaly_count FROM numbered GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    return detectors.sessions(logs(spark, sf_dir))


WITH_TERMS = WITH_LOGS + r""", words AS (SELECT log_id, regexp_extract_all(lower(message), '\w\w+') AS w FROM logs),
  terms AS (SELECT log_id, unnest(w) AS term FROM words
  UNION ALL SELECT log_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM words), top AS (
  SELECT term, count(*) AS term_count, count(DISTINCT log_id) AS document_count FROM terms GROUP BY term
  ORDER BY term_count DESC, term LIMIT 100)"""


@query(WITH_TERMS + " SELECT * FROM top")
def message_terms(spark, sf_dir):
    return text.term_counts(logs(spark, sf_dir))


@query(WITH_TERMS + """, total AS (SELECT count(*) AS n FROM logs)
  SELECT log_id, term, round(count(*) * ln((any_value(n) + 1) / (any_value(document_count) + 1)), 6) AS weight
  FROM terms JOIN top USING (term) CROSS JOIN total GROUP BY log_id, term""")
def message_vectors(spark, sf_dir):
    return text.term_weights(logs(spark, sf_dir))


# --- models -----------------------------------------------------------------------------------------------

#: A small fixed forest over (k, value): node rows as the model stores them.
_NODES = [
    (0, 0, 0, 49.5, 1, 2, 0.0, 256), (0, 1, 1, 20.25, 3, 4, 0.0, 256), (0, 2, 1, 150.0, 5, 6, 0.0, 256),
    (0, 3, 0, 0.0, 3, 3, 9.5, 256), (0, 4, 0, 0.0, 4, 4, 7.25, 256), (0, 5, 0, 0.0, 5, 5, 6.0, 256),
    (0, 6, 0, 0.0, 6, 6, 2.5, 256), (1, 0, 1, 75.0, 1, 2, 0.0, 256), (1, 1, 0, 0.0, 1, 1, 8.0, 256),
    (1, 2, 0, 89.0, 3, 4, 0.0, 256), (1, 3, 0, 0.0, 3, 3, 5.0, 256), (1, 4, 0, 0.0, 4, 4, 2.0, 256),
]
_OFFSET = -0.55


def fixed_forest() -> forest.ForestModel:
    columns = [pair.split()[0] for pair in forest.NODE_SCHEMA.split(",")]
    scaler = scoring.Scaler(["k", "value"], [0.0, 0.0], [1.0, 1.0])
    return forest.ForestModel(scaler, pd.DataFrame(_NODES, columns=columns), _OFFSET, -0.45, 0.25)


WITH_PATHS = WITH_LOGS.replace("WITH", "WITH RECURSIVE", 1) + f""", nodes(tree, node, feature, threshold, l, r, path, sampled) AS (
  VALUES {', '.join(map(str, _NODES))}), walk AS (SELECT log_id, k, value, tree, 0 AS node FROM logs, (SELECT DISTINCT tree FROM nodes)
  UNION ALL SELECT log_id, k, value, tree, CASE WHEN (CASE feature WHEN 0 THEN k ELSE value END) <= threshold THEN l ELSE r END
  FROM walk JOIN nodes USING (tree, node) WHERE l <> r), raw AS (
  SELECT log_id, -pow(2, -(sum(CAST(path AS DOUBLE)) / 2) / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256))
    - ({_OFFSET}) AS decision FROM walk JOIN nodes USING (tree, node) WHERE l = r GROUP BY log_id), found AS (
  SELECT log_id, decision, CAST(decision < 0 AS INTEGER) AS if_prediction,
    1 - (decision - min(decision) OVER ()) / (max(decision) OVER () - min(decision) OVER ()) AS if_score FROM raw)"""


@query(WITH_PATHS + """ SELECT log_id, round(decision, 6) AS if_decision, if_prediction, round(if_score, 6) AS if_score
  FROM found""")
def forest_paths(spark, sf_dir):
    """All logs through a fixed forest."""
    return forest.score_forest(logs(spark, sf_dir), fixed_forest()).select(
        "log_id", "if_decision", "if_prediction", "if_score")


@query(WITH_PATHS + """ SELECT count(*) AS total, count(*) FILTER (WHERE if_score > 0.5) AS anomalies,
  round(count(*) FILTER (WHERE if_score > 0.5) * 100.0::DOUBLE / count(*), 6) AS anomaly_percent FROM found""")
def scoring_run(spark, sf_dir):
    """The scoring job from stored features to stored results, on a fixed forest."""
    root = f"{ensure_checkpoint_dir(spark)}/scoring-{uuid.uuid4().hex}"
    sources.write_table(logs(spark, sf_dir), f"{root}/features")
    return jobs.scoring_job(spark, f"{root}/features", fixed_forest(), f"{root}/scores", f"{root}/store", as_of())


#: Sequences of three values against a fixed basis: what is left lies along (1, 1, -2).
_STEP_MEANS, _STEP_SCALE = (0.25, 0.5, 0.25), 100.0


@query(WITH_LOGS + f""", ordered AS (SELECT log_id AS first_id, row_number() OVER o - 1 AS position, value / {_STEP_SCALE} AS a,
    lead(value) OVER o / {_STEP_SCALE} AS b, lead(value, 2) OVER o / {_STEP_SCALE} AS c, greatest(is_anomaly::INT,
      lead(is_anomaly::INT) OVER o, lead(is_anomaly::INT, 2) OVER o) AS sequence_label
  FROM logs WINDOW o AS (ORDER BY timestamp, log_id)), errors AS (
  SELECT position, first_id, CAST(sequence_label AS INTEGER) AS sequence_label,
    pow(a - 0.25 + b - 0.5 - 2 * (c - 0.25), 2) / 18 AS error FROM ordered WHERE c IS NOT NULL)
  SELECT position, first_id, sequence_label, round(error, 9) AS error, CAST(error > 0.3 AS INTEGER) AS prediction,
    round((error - min(error) OVER ()) / (max(error) OVER () - min(error) OVER () + 1e-8), 9) AS score FROM errors""", digits=9)
def sequence_errors_fixed(spark, sf_dir):
    basis = np.array([[1, 1], [1, -1], [1, 0]]) / np.sqrt([3, 2])
    scaler = scoring.Scaler(["value"], [0.0], [_STEP_SCALE])
    model = sequence.SequenceModel(scaler, 3, np.array(_STEP_MEANS), basis, 0.3)
    return sequence.score_sequences(logs(spark, sf_dir), model)


@query(WITH_PATHS + """ SELECT log_id, round(decision, 6) AS if_decision, if_prediction, round(if_score, 6) AS if_score
  FROM found""")
def stored_model_scores(spark, sf_dir):
    """A forest saved, found as the newest of its folder, loaded and used."""
    root = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    forest.save_forest(spark, fixed_forest(), f"{root}/forest_1")
    loaded = forest.load_forest(spark, sources.newest_model(spark, f"{root}/forest_*"))
    return forest.score_forest(logs(spark, sf_dir), loaded).select("log_id", "if_decision", "if_prediction", "if_score")


@query(WITH_LOGS + """, draws AS (SELECT tree, log_id, CAST('0x' || substr(md5(log_id || '/' || tree || '/42'), 1, 13) AS BIGINT)
    / 4503599627370496 AS draw FROM logs, (SELECT unnest(range(20)) AS tree)), n AS (SELECT count(*) AS rows FROM logs),
  picked AS (SELECT tree, log_id, row_number() OVER (PARTITION BY tree ORDER BY draw, log_id) AS pick FROM draws, n
    WHERE rows <= 256 OR draw < least(1.0, (1.5 * 256 + 50) / rows))
  SELECT CAST(tree AS INTEGER) AS tree, log_id, CAST(pick AS INTEGER) AS pick FROM picked WHERE pick <= 256""")
def forest_draws(spark, sf_dir):
    """Which rows each of twenty trees sees, drawn by MD5."""
    rows = logs(spark, sf_dir).select("log_id")
    return forest.draw_samples(rows, rows.count(), 20, 256, 42, unit=forest._md5_share).select("tree", "log_id", "pick")


@query()
def forest_scores(spark, sf_dir):
    scored = forest.fit_and_score_forest(stored_features(spark, sf_dir, schemas.FOREST_FEATURES))[1]
    return scoring.combine_scores(scored).select(
        "log_id", "if_prediction", "if_score", "combined_score", "is_anomaly_predicted")


@query()
def sequence_errors(spark, sf_dir):
    return sequence.fit_and_score_sequences(stored_features(spark, sf_dir, ["is_anomaly", *schemas.SEQUENCE_FEATURES]))[1]


def stored_features(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """What a model reads of the feature table: stored once, since fitting passes over it several times."""
    table = features.build_features(logs(spark, sf_dir))
    return materialize(table.select(*dict.fromkeys(["log_id", "timestamp", *columns])))

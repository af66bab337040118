"""Test input of the registered queries: the ``events`` table read as application logs.

The mapping is ours and covers every branch of the operators; ``catalog.LOGS_SQL`` says the same in SQL, written
apart from this code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.schemas import struct

LOG_TYPE_OF = {
    "view": "API_REQUEST", "click": "USER_ACTION", "purchase": "DATABASE_QUERY", "signup": "SYSTEM_EVENT",
}


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per event; the event's helper number ``k`` decides codes, levels and anomalies."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "k", F.from_json("props", struct("k int"))["k"])
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in LOG_TYPE_OF.items() for x in pair])[F.col("event_type")],
                      F.lit("ERROR"))
    request, action, query, system = (kind == t for t in LOG_TYPE_OF.values())
    digit = F.col("k") % 10
    status = F.when(digit < 6, 200).when(digit == 6, 206).when(digit == 7, 301).when(digit == 8, 429).otherwise(503)
    level = (
        F.when(request, F.when(digit >= 8, "WARN").otherwise("INFO"))
        .when(query, F.when(F.col("k") < 50, "DEBUG").otherwise("INFO"))
        .when(action, "INFO").when(system, F.when(F.col("k") >= 95, "CRITICAL").otherwise("INFO")).otherwise("ERROR")
    )
    k = F.col("k").cast("string")
    message = (
        F.when(request, F.concat(F.lit("GET /shelf answered "), status.cast("string"), F.lit(" after "), k, F.lit("ms")))
        .when(query, F.concat(F.lit("SELECT over shelf "), k, F.lit(" gave rows")))
        .when(action, F.concat(F.lit("visitor opened page "), k))
        .when(system, F.lit("heartbeat of node fine")).otherwise(F.lit("worker stopped without answer"))
    )
    return events.select(
        F.concat(F.lit("log_"), F.col("event_id").cast("string")).alias("log_id"), F.col("ts").alias("timestamp"),
        kind.alias("log_type"), "k", F.when(request, status).alias("status_code"),
        F.when(request, F.col("value")).alias("response_time_ms"),
        F.when(query, F.col("value")).alias("execution_time_ms"), level.alias("log_level"),
        F.when(request | action, F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("user_id"),
        message.alias("message"),
        ((F.col("value") >= 150) | ((F.col("event_type") == "error") & (F.col("k") >= 90))).alias("is_anomaly"),
        "event_id", "value",
    )

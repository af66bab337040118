"""Hourly summary of scored logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hourly_summary(scored: DataFrame, score: str = "combined_score", flag: str = "is_anomaly_predicted",
                   width: str = "1 hour", approximate_users: bool = False) -> DataFrame:
    """Tumbling windows per log type: volume, mean and highest score, anomalies, distinct users."""
    return flat_window(
        scored.groupBy(F.window("timestamp", width), "log_type").agg(*summary_columns(score, flag, approximate_users))
    )


def summary_columns(score: str, flag: str, approximate_users: bool) -> list[Column]:
    users = F.approx_count_distinct("user_id") if approximate_users else F.count_distinct("user_id")
    return [
        F.count(F.lit(1)).alias("log_count"),
        F.avg(score).alias("avg_anomaly_score"),
        F.max(score).alias("max_anomaly_score"),
        F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).alias("anomaly_count"),
        users.alias("unique_users"),
    ]


def flat_window(df: DataFrame) -> DataFrame:
    """The window struct as two leading columns."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def top_windows(summary: DataFrame, n: int = 10) -> DataFrame:
    """Windows by highest score; window start and log type decide between equals."""
    return summary.orderBy(F.desc("max_anomaly_score"), "window_start", "log_type").limit(n)

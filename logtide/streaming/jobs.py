"""Structured Streaming forms: hourly summary, sliding volume, deduplication, scoring of features or log rows.

Each takes any streaming DataFrame of logs (files, a message queue, …). Watermarks need a zoned
timestamp, hence the cast; results carry zone-less timestamps like the batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtide.models.forest import ForestModel, score_forest
from logtide.operators.results import merge_anomalies, open_alerts
from logtide.operators.scoring import anomaly_rows, combine_scores
from logtide.operators.summary import flat_window, summary_columns
from logtide.plans.materialize import scratch
from logtide.streaming.features import stream_features


def _with_watermark(logs: DataFrame, late: str) -> DataFrame:
    return logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)


def _plain_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def deduplicate(logs: DataFrame, late: str = "1 hour", key: str = "log_id") -> DataFrame:
    """First arrival of each key; copies arriving within the watermark are dropped."""
    return _with_watermark(logs, late).dropDuplicatesWithinWatermark([key])


def hourly_summary(scored: DataFrame, late: str = "1 hour", width: str = "1 hour", score: str = "combined_score",
                   flag: str = "is_anomaly_predicted") -> DataFrame:
    """Hourly summary per log type; rows later than the watermark are dropped. Distinct users are
    approximate, as a stream cannot keep every user of every window."""
    summary = (
        _with_watermark(scored, late).groupBy(F.window("timestamp", width), "log_type")
        .agg(*summary_columns(score, flag, approximate_users=True))
    )
    return _plain_times(flat_window(summary))


def sliding_volume(logs: DataFrame, width: str = "1 hour", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Row count per log type in sliding windows, the streaming form of the trailing counts."""
    counts = (
        _with_watermark(logs, late).groupBy(F.window("timestamp", width, slide), "log_type")
        .agg(F.count(F.lit(1)).alias("log_count"))
    )
    return _plain_times(flat_window(counts))


def user_sessions(logs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream, given out once the watermark has passed their pause; the rows of ``detectors.sessions``.

    A session window ends its pause behind the last row and takes no row at that very moment, hence the microsecond.
    """
    windows = F.session_window("timestamp", f"{gap} 1 microsecond")
    found = (
        _with_watermark(logs, late).filter(F.col("user_id").isNotNull()).groupBy(windows.alias("_session"), "user_id")
        .agg(F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
             F.count(F.lit(1)).alias("log_count"), F.count_if(F.col("is_anomaly")).alias("anomaly_count"))
    )
    return _plain_times(found.drop("_session")).select(
        "user_id", "session_start", "session_end", "log_count", "anomaly_count")


def _store_findings(rows: DataFrame, model: ForestModel, store_root: str, threshold: float, alerts: bool) -> None:
    scored = combine_scores(score_forest(rows, model, relative_to_training=True), threshold=threshold)
    found = anomaly_rows(scored).withColumn("detected_at", F.col("timestamp"))
    stored = merge_anomalies(rows.sparkSession, store_root, found, own_days=True)
    if alerts:
        open_alerts(rows.sparkSession, store_root, stored)


def score_stream(features: DataFrame, model: ForestModel, store_root: str, checkpoint: str,
                 threshold: float = 0.5, alerts: bool = True, **trigger) -> StreamingQuery:
    """Score a stream of feature rows and merge the anomalies of each micro-batch into the anomaly table.

    Scores are relative to the training range, so that they do not depend on how the stream is cut. Anomalies count
    as detected at their own time, so a batch touches its own days only: new rows are appended, known keys looked up
    there, and what else is stored is not read. A batch repeated after a failure merges to the same tables. With
    ``alerts`` anomalies of high score get one.
    """
    def merge(batch: DataFrame, _: int) -> None:
        with scratch():
            _store_findings(batch, model, store_root, threshold, alerts)

    return (
        features.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def score_raw_stream(logs: DataFrame, model: ForestModel, statistics: DataFrame, store_root: str, checkpoint: str,
                     late: str = "10 minutes", threshold: float = 0.5, alerts: bool = True, **trigger) -> StreamingQuery:
    """Score a stream of log rows: features from keyed state (``stream_features``), scores, anomalies and alerts.

    ``statistics`` are the log-type statistics of the training rows, so that features mean what they meant there. A
    row is scored once the watermark has passed its second.
    """
    return score_stream(stream_features(logs, statistics, late), model, store_root, checkpoint, threshold, alerts, **trigger)

"""Composite jobs from stored input to stored output."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.models.forest import ForestModel, fit_forest, load_forest, save_forest, score_forest
from logtide.models.sequence import SequenceModel, fit_sequences, save_sequences, score_sequences
from logtide.operators.enrich import build_enriched
from logtide.operators.evaluate import evaluate, holdout_split, metric_rows, time_split
from logtide.operators.features import build_features
from logtide.operators.monitor import quality_warnings, require_quality
from logtide.operators.reports import counts_by_flag
from logtide.operators.results import (
    conform, merge_anomalies, new_rows, open_alerts, performance_rows, report_rows, retain, with_day_ids,
)
from logtide.operators.scoring import (
    anomaly_rows, combine_scores, predicted_anomalies, result_columns, run_summary,
)
from logtide.operators.summary import hourly_summary, top_windows
from logtide.schemas import ALERTS, ANOMALIES, FEATURE_STATISTICS, LOGS_METADATA, MODEL_PERFORMANCE
from logtide.plans.bounded import settle
from logtide.plans.materialize import materialize, scratch
from logtide.sources import tables
from logtide.sources.logs import newest_model, read_logs, read_raw_logs, write_table


def features_job(spark: SparkSession, logs_path: str, out_path: str, check: bool = True) -> DataFrame:
    """Raw logs - flat, or with a JSON payload and times as text - to the stored feature table.

    With ``check`` the quality rules come first: rows that break one raise before anything is written.
    """
    logs = read_raw_logs(spark, logs_path)
    if check:
        require_quality(logs)
    with scratch():
        write_table(build_features(logs), out_path)
    return read_logs(spark, out_path)


def scoring_job(spark: SparkSession, features_path: str, model: ForestModel, out_path: str, store_root: str,
                now: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """Score a feature table, store results, anomalies and alerts; returns the run summary.

    The rows are scored once; everything after that reads the stored result.
    """
    features = read_logs(spark, features_path)
    scored = combine_scores(score_forest(features, model), threshold=threshold)
    with scratch():
        write_table(result_columns(scored), out_path)
        # results have no level; the few flagged rows fetch it instead of being scored again
        flagged = predicted_anomalies(read_logs(spark, out_path)).join(features.select("log_id", "log_level"), "log_id")
        found = merge_anomalies(spark, store_root, anomaly_rows(flagged), now)
        open_alerts(spark, store_root, found)
    return run_summary(read_logs(spark, out_path))


@dataclass(frozen=True)
class Enrichment:
    """Results of the enrichment job; ``summary`` and ``top`` only for rows with a score."""

    rows: DataFrame
    bursts: DataFrame
    summary: DataFrame | None
    top: DataFrame | None


def enrichment_job(spark: SparkSession, logs_path: str, out_path: str, score: str | None = None,
                   flag: str = "is_anomaly_predicted", top: int = 10) -> Enrichment:
    """Raw logs to the stored enrichment, one folder per log type, with burst counts, the hourly summary
    and its highest windows, all read from the stored rows."""
    with scratch():
        write_table(build_enriched(read_raw_logs(spark, logs_path)), out_path, partition_by=["log_type"])
    enriched = read_logs(spark, out_path)
    summary = hourly_summary(enriched, score, flag) if score else None
    return Enrichment(enriched, counts_by_flag(enriched), summary, top_windows(summary, top) if score else None)


def _store_metrics(spark: SparkSession, quality: DataFrame, name: str, store_root: str, date: Column | None) -> None:
    stored = tables.read_table(spark, store_root, "model_performance", MODEL_PERFORMANCE)
    rows = performance_rows(metric_rows(quality), name, "v1.0", date)
    tables.append_table(new_rows(stored, rows, MODEL_PERFORMANCE, "created_at", "metric_name"), store_root,
                        "model_performance", MODEL_PERFORMANCE, "created_at")


def train_forest_job(spark: SparkSession, features_path: str, model_path: str, store_root: str,
                     date: Column | None = None, share: float = 0.8, **options) -> ForestModel:
    """Fit and store the forest on ``share`` of the rows, and record its quality on the others where labelled."""
    features = read_logs(spark, features_path)
    training, test = holdout_split(features, share)
    model = fit_forest(training, **options)
    save_forest(spark, model, model_path)
    if "is_anomaly" in features.columns:
        scored = score_forest(test, model, relative_to_training=True)
        _store_metrics(spark, evaluate(scored, "is_anomaly", "if_prediction"), "isolation_forest", store_root, date)
    return model


def train_sequences_job(spark: SparkSession, features_path: str, model_path: str, store_root: str,
                        date: Column | None = None, share: float = 0.8, **options) -> SequenceModel:
    """Fit and store the sequence model on the earliest ``share`` of the rows, and record its quality on the later
    ones where labelled."""
    features = read_logs(spark, features_path)
    training, test = time_split(features, share)
    model = fit_sequences(training, **options)
    save_sequences(spark, model, model_path)
    if "is_anomaly" in features.columns:
        scored = score_sequences(test, model)
        _store_metrics(spark, evaluate(scored, "sequence_label", "prediction"), "sequence_autoencoder", store_root, date)
    return model


def newest_scoring_job(spark: SparkSession, features_path: str, models: str, out_path: str, store_root: str,
                       now: Column | None = None) -> DataFrame:
    """``scoring_job`` with the newest stored forest among the folders that match ``models``."""
    return scoring_job(spark, features_path, load_forest(spark, newest_model(spark, models)), out_path, store_root, now)


def monitoring_job(spark: SparkSession, store_root: str, as_of: Column, days: int = 7, floor: float = 0.7) -> DataFrame:
    """Recent metrics under the floor; each becomes an open alert without an anomaly, once per model and day."""
    performance = tables.read_table(spark, store_root, "model_performance", MODEL_PERFORMANCE)
    warnings = quality_warnings(performance, as_of, days, floor=floor)
    alerts = tables.read_table(spark, store_root, "alerts", ALERTS)
    text = F.concat_ws(" ", "model_name", "metric_name", F.round("metric_value", 4).cast("string"), F.lit("on"),
                       F.col("evaluation_date").cast("string"))
    rows = warnings.select(
        F.lit("high").alias("severity"), F.lit("model_quality").alias("alert_type"), text.alias("description"),
        F.lit("open").alias("status"), as_of.cast("timestamp_ntz").alias("created_at")).distinct()
    fresh = rows.join(alerts.select("alert_type", "description"), ["alert_type", "description"], "left_anti")
    fresh = settle(fresh)
    if not fresh.isEmpty():
        small = not hasattr(fresh, "_stored_at")
        added = with_day_ids(fresh, spark, store_root, "alerts", ALERTS, "created_at", "description", small)
        tables.append_table(materialize(conform(added, ALERTS)), store_root, "alerts", ALERTS, "created_at")
    return warnings


def daily_report_job(spark: SparkSession, store_root: str, date: str) -> DataFrame:
    """Store the batch row of one day; returns all stored reports. Only that day's anomalies are read."""
    anomalies = tables.read_table(spark, store_root, "anomalies", ANOMALIES, [date])
    reports = tables.read_table(spark, store_root, "logs_metadata", LOGS_METADATA)
    row = materialize(new_rows(reports, report_rows(anomalies, date), LOGS_METADATA, "created_at", "batch_id"))
    tables.append_table(row, store_root, "logs_metadata", LOGS_METADATA, "created_at")
    return tables.read_table(spark, store_root, "logs_metadata", LOGS_METADATA)


def daily_job(spark: SparkSession, logs_path: str, work_path: str, models: str, store_root: str, date: str) -> DataFrame:
    """One day's chain: quality gate, features, scoring with the newest model, warnings, report, retention, compaction.

    Returns the stored reports. A failed gate raises before anything is written.
    """
    as_of = (F.to_date(F.lit(date)) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    features_job(spark, logs_path, f"{work_path}/features")
    moment = F.to_date(F.lit(date)).cast("timestamp_ntz")
    newest_scoring_job(spark, f"{work_path}/features", models, f"{work_path}/scores", store_root, moment)
    monitoring_job(spark, store_root, as_of)
    reports = daily_report_job(spark, store_root, date)
    retention_job(spark, store_root, as_of)
    compaction_job(spark, store_root, date)
    return reports


def retention_job(spark: SparkSession, store_root: str, as_of: Column, anomaly_days: int = 90,
                  statistics_days: int = 180) -> None:
    """Drop old anomalies and old feature statistics: the folders of days that are old as a whole, and the old rows
    of the day that the limit falls into. No other row is read or written; a limit at midnight writes none."""
    for name, schema, column, kept in (
        ("anomalies", ANOMALIES, "detected_at", anomaly_days),
        ("feature_statistics", FEATURE_STATISTICS, "calculation_date", statistics_days),
    ):
        limit = as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(kept))
        day, inside = spark.range(1).select(
            F.to_date(limit).cast("string"), limit > F.to_date(limit).cast("timestamp_ntz")).first()
        tables.drop_days(spark, store_root, name, day)
        border = tables.read_table(spark, store_root, name, schema, [day])
        if inside and not border.isEmpty():
            left = materialize(retain(border, column, as_of, kept))
            if left.isEmpty():
                tables.drop_days(spark, store_root, name, (dt.date.fromisoformat(day) + dt.timedelta(1)).isoformat())
            else:
                tables.replace_days(left, store_root, name, schema, column)


def compaction_job(spark: SparkSession, store_root: str, date: str) -> None:
    """Write one day of anomalies and of alerts in few files sorted by key; micro-batches leave a file each."""
    tables.compact(spark, store_root, "anomalies", ANOMALIES, "detected_at", [date])
    tables.compact(spark, store_root, "alerts", ALERTS, "created_at", [date])

"""Exploration tables: volumes, value counts, histograms, box statistics, metric comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize
from logtide.plans.quantiles import exact_quantiles


def overview(logs: DataFrame) -> DataFrame:
    """Rows, time range and anomaly rate in percent."""
    return logs.agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        (F.avg(F.col("is_anomaly").cast("int")) * 100).alias("anomaly_rate_percent"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, null left out, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )


def counts_by_flag(df: DataFrame, flag: str = "is_burst") -> DataFrame:
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("count"))


def volume_by_hour(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("count")).orderBy("hour")


def daily_volume(logs: DataFrame) -> DataFrame:
    return (
        logs.groupBy(F.to_date("timestamp").alias("date"))
        .agg(F.count("log_id").alias("total_logs"), F.count_if(F.col("is_anomaly")).alias("anomalies"))
        .orderBy("date")
    )


def histogram(df: DataFrame, column: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed, empty ones left out.

    With ``by`` every class has its own range. Equal values all fall into bin 0.
    """
    key = F.col(by) if by else F.lit(0)
    rows = df.filter(F.col(column).isNotNull()).select(key.alias("_by"), F.col(column).cast("double").alias("_v"))
    rows = rows.filter(F.col("_by").isNotNull())
    ranges = rows.groupBy("_by").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_no = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    counted = (
        join_small(rows, ranges, "_by").groupBy("_by", bin_no.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    )
    step = (F.col("_hi") - F.col("_lo")) / bins
    return counted.select(
        *([F.col("_by").alias(by)] if by else []), "bin",
        (F.col("_lo") + F.col("bin") * step).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * step).alias("bin_end"), "count",
    )


def box_statistics(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whiskers (farthest values within 1.5 IQR of the box) and outliers per class."""
    rows = materialize(df.filter(F.col(column).isNotNull() & F.col(by).isNotNull()).select(by, column))
    box = exact_quantiles(rows, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    return join_small(rows, box, by).groupBy(by).agg(
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col(column))).alias("whisker_low"),
        F.max(F.when(inside, F.col(column))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def metric_comparison(performance: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per model, one column per metric: the newest value of each."""
    return performance.groupBy("model_name").pivot("metric_name", metrics).agg(
        F.max_by("metric_value", F.struct("evaluation_date", "id")))


def metric_history(performance: DataFrame) -> DataFrame:
    return performance.select("model_name", "metric_name", "metric_value", "evaluation_date").orderBy(
        F.desc("evaluation_date"), "model_name", "metric_name")


def largest(df: DataFrame, column: str, n: int, keep: list[str], tie: str) -> DataFrame:
    """The ``n`` rows with the largest value."""
    return df.orderBy(F.desc(column), tie).limit(n).select(*keep)

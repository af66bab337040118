"""Statistical detectors and further rolling statistics of the settings file."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions import logs as fn
from logtide.operators.features import LOG_ORDER, attach_cells
from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize
from logtide.plans.ordering import SLICE_ROWS, RowOrder, with_position
from logtide.plans.quantiles import exact_quantile
from logtide.plans.trailing import Trailing, over_trailing, per_second


def seasonal_anomalies(df: DataFrame, value: str, season: Column, threshold: float = 3.0,
                       history: DataFrame | None = None, by: str = "log_type") -> DataFrame:
    """Flag values far off the mean of their (``by``, season) group, with history from ``history`` or
    from the table itself. Without history there is no flag."""
    def seasons(rows: DataFrame) -> DataFrame:
        return rows.withColumn("season", season)

    past = seasons(df if history is None else history).groupBy(by, "season").agg(
        F.avg(value).alias("historical_mean"), F.stddev_samp(value).alias("historical_std"))
    flag = fn.is_seasonal_anomaly(F.col(value), F.col("historical_mean"), F.col("historical_std"), threshold)
    return join_small(seasons(df), past, [by, "season"]).withColumn(
        "is_seasonal_anomaly", F.coalesce(flag, F.lit(False)))


def statistical_detector(df: DataFrame, value: str = "response_time_ms", by: str = "log_type",
                         z_cut: float = 3.0, percentile: float = 99.0) -> DataFrame:
    """Two votes per row, |z| over ``z_cut`` and value over its type's exact percentile, and their union."""
    values = materialize(df.select(by, value))
    stats = values.groupBy(by).agg(F.avg(value).alias("value_mean"), F.stddev_samp(value).alias("value_std"))
    limits = exact_quantile(values.filter(F.col(by).isNotNull()), value, percentile / 100.0, [by], "value_limit")
    z = fn.zscore(F.col(value), F.col("value_mean"), F.col("value_std"))
    scored = join_small(df, stats.join(limits, by, "left"), by).withColumns({
        "value_zscore": z,
        "is_z_anomaly": F.when(F.abs(z) > z_cut, 1).otherwise(0),
        "is_percentile_anomaly": fn.above(F.col(value), F.col("value_limit")),
    })
    return scored.withColumn(
        "is_statistical_anomaly", F.greatest("is_z_anomaly", "is_percentile_anomaly"))


# The window lengths in minutes of the rolling grid.
GRID_MINUTES = [5, 15, 30, 60]


def rolling_grid(df: DataFrame, value: str = "response_time_ms", minutes: list[int] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum and maximum of ``value`` over several trailing windows."""
    minutes = minutes or GRID_MINUTES
    frames = {}
    for m in minutes:
        frames |= {
            f"count_{m}min": Trailing("sum", m * 60, "_rows"), f"mean_{m}min": Trailing("mean", m * 60),
            f"std_{m}min": Trailing("variance", m * 60), f"min_{m}min": Trailing("min", m * 60, "_min"),
            f"max_{m}min": Trailing("max", m * 60, "_max"),
        }
    cells = over_trailing(per_second(df, LOG_ORDER, value=F.col(value)), frames)
    cells = cells.withColumns({f"std_{m}min": F.sqrt(f"std_{m}min") for m in minutes})
    out = [f"{stat}_{m}min" for m in minutes for stat in ("count", "mean", "std", "min", "max")]
    return attach_cells(df, cells.select("_key", "_sec", "_rows", *out))


def ewma(df: DataFrame, value: str = "response_time_ms", alpha: float = 0.3, order: RowOrder = LOG_ORDER,
         slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exponentially weighted moving average per log type: y = alpha * x + (1 - alpha) * y_previous.

    Rows without a value are left out of the series and get null. A slice of n rows turns the average before it
    into a share (1 - alpha)^n of the average behind it plus a sum of its own; these two numbers are chained over
    the slices of a key, and each slice then starts from the average that was carried to it. Nothing is forgotten,
    so ``slice_rows`` is a setting of the plan. Only key, position and value pass through Python.
    """
    # a series of its own for the rows with a value, named apart from the rest
    series = F.concat_ws("/", order.key_column(), F.col(value).isNotNull().cast("string"))
    named = RowOrder("_series", order.time, order.tie)
    placed = with_position(df.withColumn("_series", series), named).drop("_sec", "_series")
    narrow = df.filter(F.col(value).isNotNull()).select(
        series.alias("_series"), order.time, order.tie, F.col(value).cast("double").alias("_x"))
    size = max(1, slice_rows)
    rows = materialize(with_position(narrow, named).select(
        "_key", "_pos", "_x", F.floor(F.col("_pos") / size).alias("_slice")))
    left = 1.0 - alpha
    to_end = (F.col("_slice") + 1) * size - 1 - F.col("_pos")  # only whole slices are carried on from
    ends = rows.groupBy("_key", "_slice").agg(
        F.sum(alpha * F.pow(F.lit(left), to_end) * F.col("_x")).alias("_sum"),
        F.min_by("_x", "_pos").alias("_first"))

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("_slice")
        carried, at = [], group["_first"][0].as_py()
        for own in group["_sum"].to_pylist():
            carried.append(at)
            at = own + left ** size * at
        return pa.table({"_key": group["_key"], "_slice": group["_slice"], "_carried": pa.array(carried, pa.float64())})

    carried = ends.groupBy("_key").applyInArrow(chain, "_key string, _slice long, _carried double")

    def smooth(group: pa.Table) -> pa.Table:
        group = group.sort_by("_pos")
        series = pd.Series([group["_carried"][0].as_py(), *group["_x"].to_pylist()])
        smoothed = series.ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
        return pa.table({"_key": group["_key"], "_pos": group["_pos"], "ewma": pa.array(smoothed)})

    averages = join_small(rows, carried, ["_key", "_slice"]).groupBy("_key", "_slice").applyInArrow(
        smooth, "_key string, _pos long, ewma double")
    return placed.drop("ewma").join(averages, ["_key", "_pos"], "left").drop("_key", "_pos")


def sessions(df: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """User sessions, split at pauses longer than the gap, with the anomalies in each.

    Rows are first combined per (user, second). Pauses are found within (user, day); each day also gets the last
    moment before it and the number of sessions begun before it from the users' day table, so one busy user is
    spread over as many groups as days.
    """
    seconds = materialize(
        df.filter(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("user_id", F.unix_timestamp("timestamp").alias("_sec"))
        .agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"),
             F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("is_anomaly")).alias("_anomalies"))
        .withColumn("_day", F.floor(F.col("_sec") / 86_400))
    )
    days = Window.partitionBy("user_id").orderBy("_day")
    inside = Window.partitionBy("user_id", "_day").orderBy("_sec")
    before = seconds.groupBy("user_id", "_day").agg(F.max("_last").alias("_end")).select(
        "user_id", "_day", F.lag("_end").over(days).alias("_before"))
    pause = F.col("_first") - F.coalesce(F.lag("_last").over(inside), "_before") > F.make_dt_interval(secs=F.lit(gap_seconds))
    split = seconds.join(before, ["user_id", "_day"]).withColumn("_new", F.coalesce(pause, F.lit(False)).cast("int"))
    begun = split.groupBy("user_id", "_day").agg(F.sum("_new").alias("_begun")).select("user_id", "_day", F.coalesce(
        F.sum("_begun").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        split.join(begun, ["user_id", "_day"]).withColumn("_session", F.col("_earlier") + running)
        .groupBy("user_id", "_session")
        .agg(F.min("_first").alias("session_start"), F.max("_last").alias("session_end"),
             F.sum("_rows").alias("log_count"), F.sum("_anomalies").alias("anomaly_count"))
        .drop("_session")
    )

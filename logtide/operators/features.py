"""Feature table: temporal, rolling, categorical, statistical and lag features of every log row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions import logs as fn
from logtide.plans.bounded import fetch_bounded, join_small
from logtide.plans.materialize import materialize
from logtide.plans.ordering import RowOrder, slice_window, with_cell, with_position, with_slices
from logtide.plans.quantiles import exact_quantile
from logtide.plans.trailing import Trailing, over_trailing, per_second
from logtide.schemas import FEATURE_TABLE, FEATURE_TABLE_EXTRA

LOG_ORDER = RowOrder("log_type", "timestamp", "log_id")

#: Lagged columns: prefix of the output name -> input column.
LAGGED = {"response_time_lag": "response_time_ms", "count_lag": "count_5min"}


def temporal_features(df: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return df.withColumns({
        "hour": fn.hour_of_day(ts),
        "day_of_week": fn.day_of_week(ts),
        "is_weekend": fn.is_weekend(ts),
        "is_business_hours": fn.is_business_hours(ts),
    })


def rolling_cells(df: DataFrame) -> DataFrame:
    """Trailing counts and API response-time statistics, one row per (log type, second)."""
    response_time = fn.api_response_time(F.col("log_type"), F.col("response_time_ms"))
    cells = per_second(df, LOG_ORDER, F.count("log_id").alias("_ids"), value=response_time)
    trailing = over_trailing(cells, {
        "count_5min": Trailing("sum", 300, "_ids"),
        "count_15min": Trailing("sum", 900, "_ids"),
        "count_1hour": Trailing("sum", 3600, "_ids"),
        "avg_response_time_5min": Trailing("mean", 300),
        "max_response_time_5min": Trailing("max", 300, "_max"),
    })
    return trailing.fillna(0.0, ["avg_response_time_5min", "max_response_time_5min"])


def attach_cells(df: DataFrame, cells: DataFrame, order: RowOrder = LOG_ORDER) -> DataFrame:
    """Give every row the values of its (key, second)."""
    return with_cell(df, order).join(cells.drop("_rows"), ["_key", "_sec"]).drop("_key", "_sec")


def rolling_statistics(df: DataFrame) -> DataFrame:
    """Trailing 5 min, 15 min and 1 h counts per log type, 5 min mean and maximum of the response time."""
    return attach_cells(df, rolling_cells(df))


def type_statistics(df: DataFrame) -> DataFrame:
    """One row per log type: frequency index, mean, sample deviation and exact p95 of the response time.

    The index counts from the most frequent type; ties go by name. Up to ``BROADCAST_ROWS`` types are
    ranked in one place; a longer list takes its ranks from the distributed row order.
    """
    values = materialize(df.select("log_type", "response_time_ms"))
    stats = values.groupBy("log_type").agg(
        F.count(F.lit(1)).alias("type_rows"),
        F.avg("response_time_ms").alias("mean_response_time"),
        F.stddev_samp("response_time_ms").alias("std_response_time"),
    )
    p95 = exact_quantile(values, "response_time_ms", 0.95, ["log_type"], "p95_response_time", discrete=True)
    stats = join_small(stats, p95, "log_type", null_safe=True)
    head = fetch_bounded(stats)
    if head is not None:
        stats = df.sparkSession.createDataFrame(head, schema=stats.schema)
        rank = Window.partitionBy(F.col("log_type").isNull()).orderBy(F.desc("type_rows"), "log_type")
        index = F.row_number().over(rank) - 1
    else:
        stats = materialize(stats).withColumns({
            "_null": F.col("log_type").isNull(), "_order": F.timestamp_seconds(-F.col("type_rows"))})
        stats = with_position(stats, RowOrder("_null", "_order", "log_type"))
        index = F.col("_pos")
    return stats.withColumn(
        "log_type_indexed", F.when(F.col("log_type").isNotNull(), index).cast("double"),
    ).select("log_type", "log_type_indexed", "mean_response_time", "std_response_time", "p95_response_time")


def encode_categories(df: DataFrame) -> DataFrame:
    """Level code and frequency index of the log type."""
    index = type_statistics(df).select("log_type", "log_type_indexed")
    return join_small(df.withColumn("log_level_encoded", fn.level_code(F.col("log_level"))), index, "log_type")


def _add_statistical(df: DataFrame) -> DataFrame:
    value = F.col("response_time_ms")
    return df.withColumns({
        "response_time_zscore": fn.zscore(value, F.col("mean_response_time"), F.col("std_response_time")),
        "is_slow_response": fn.above(value, F.col("p95_response_time")),
    })


def statistical_features(df: DataFrame) -> DataFrame:
    """Response-time z-score and slow flag against the statistics of the row's log type."""
    return _add_statistical(join_small(df, type_statistics(df).drop("log_type_indexed"), "log_type"))


def _add_lags(positioned: DataFrame, steps: int = 3, slice_rows: int | None = None) -> DataFrame:
    sliced = with_slices(positioned, before=steps, **({"slice_rows": slice_rows} if slice_rows else {}))
    window = slice_window()
    lags = {
        f"{prefix}_{i}": F.lag(column, i).over(window)
        for i in range(1, steps + 1) for prefix, column in LAGGED.items()
    }
    return sliced.withColumns(lags).filter("_own").drop("_slice", "_own", "_key", "_sec", "_pos")


def sequence_features(df: DataFrame, steps: int = 3, slice_rows: int | None = None) -> DataFrame:
    """The last ``steps`` response times and 5 min counts of the same log type, then zero for every
    missing number of the table."""
    return _add_lags(with_position(df, LOG_ORDER), steps, slice_rows).fillna(0)


def select_existing(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names of those that do not."""
    missing = [c for c in wanted if c not in df.columns]
    return df.select(*[c for c in wanted if c in df.columns]), missing


def build_features(logs: DataFrame, slice_rows: int | None = None, statistics: DataFrame | None = None,
                   **position_options) -> DataFrame:
    """The whole feature table. ``statistics`` are those of the rows themselves, unless ``type_statistics`` of
    others - say, of the rows a model was trained on - are given.

    The rows are shuffled twice: by (log type, second) to receive the rolling values and their
    position, and by slice for the lags. Everything else is a projection or a checked broadcast.
    """
    rows = temporal_features(logs).withColumn("log_level_encoded", fn.level_code(F.col("log_level")))
    rows = _add_statistical(join_small(rows, type_statistics(logs) if statistics is None else statistics, "log_type"))
    rows, _ = select_existing(rows, FEATURE_TABLE + FEATURE_TABLE_EXTRA)
    cells = materialize(rolling_cells(logs))
    positioned = with_position(rows, LOG_ORDER, cells=cells, **position_options)
    features = _add_lags(positioned, slice_rows=slice_rows).fillna(0)
    return select_existing(features, FEATURE_TABLE + FEATURE_TABLE_EXTRA)[0]

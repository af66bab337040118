"""Log enrichment: status codes, inter-arrival times, hourly variability, entropy and bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import logs as fn
from logtide.operators.features import LOG_ORDER, attach_cells
from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize
from logtide.plans.ordering import RowOrder, slice_window, with_position, with_slices
from logtide.plans.trailing import Trailing, over_trailing, per_second
from logtide.schemas import LOG_LEVELS

HOUR = 3600
#: Rows of the row-based burst frame, the current one included.
BURST_ROWS = 11


def status_features(df: DataFrame) -> DataFrame:
    """Status code found in the message, and whether it says error (400 and above)."""
    status = fn.status_text(F.col("message"))
    return df.withColumns({"extracted_status_code": status, "is_error_status": fn.is_error_status(status)})


def _add_arrival(positioned: DataFrame, slice_rows: int | None = None) -> DataFrame:
    sliced = with_slices(positioned, before=1, **({"slice_rows": slice_rows} if slice_rows else {}))
    previous = F.lag("timestamp", 1).over(slice_window())
    gap = F.unix_timestamp("timestamp") - F.unix_timestamp("prev_timestamp")
    return (
        sliced.withColumn("prev_timestamp", previous).filter("_own")
        .withColumn("inter_arrival_seconds",
                    F.when(F.col("prev_timestamp").isNotNull(), gap).otherwise(0).cast("long"))
        .drop("_slice", "_own")
    )


def inter_arrival(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Previous timestamp of the same log type and the seconds since then; 0 for the first row."""
    return _add_arrival(with_position(df, LOG_ORDER), slice_rows).drop("_key", "_sec", "_pos")


def _level_counts() -> list[Column]:
    return [F.count_if(F.col("log_level") == level).alias(f"_level_{level}") for level in LOG_LEVELS]


def hourly_cells(df: DataFrame, frame: int = HOUR) -> DataFrame:
    """Variability of the trailing hour, one row per (log type, second).

    ``log_level_entropy`` is the Shannon entropy of the log levels in the frame.
    ``log_level_entropy_literal`` sums ``1/n * log2(n)`` over the frame, where n is the hour count each
    row has itself; it measures volume rather than diversity and is kept for comparison.
    """
    cells = per_second(
        df, LOG_ORDER, F.count("log_level").alias("_levels"), *_level_counts(), value=F.col("response_time_ms"),
    )
    levels = [f"_level_{level}" for level in LOG_LEVELS]
    hourly = over_trailing(cells, {
        "count_per_hour": Trailing("sum", frame, "_rows"),
        "_known": Trailing("sum", frame, "_levels"),
        "_mean_time": Trailing("mean", frame),
        "variance_response_time": Trailing("variance", frame),
        **{f"_in{name}": Trailing("sum", frame, name) for name in levels},
    }, keep=["_levels"])
    mean = F.col("_mean_time")
    hourly = hourly.withColumns({
        "log_level_entropy": F.when(
            F.col("_known") > 0, fn.entropy_bits([F.col(f"_in{name}") for name in levels], F.col("_known")),
        ).otherwise(0.0),
        "_term": F.col("_levels") * F.log2(F.col("count_per_hour")) / F.col("count_per_hour"),
        "coefficient_variation": F.when(mean != 0, F.sqrt("variance_response_time") / mean).otherwise(0.0),
    })
    return over_trailing(
        hourly, {"log_level_entropy_literal": Trailing("sum", frame, "_term")},
        keep=["count_per_hour", "variance_response_time", "coefficient_variation", "log_level_entropy"],
    )


def hourly_variability(df: DataFrame) -> DataFrame:
    """Count, variance, coefficient of variation and level entropy of the trailing hour."""
    return attach_cells(df, hourly_cells(df))


def _burst_limits(cells: DataFrame, rows: int) -> DataFrame:
    """Mean and deviation, per key, of the row-frame counts min(1, rows), min(2, rows), … min(n, rows).

    The k-th row of a key sees min(k, rows) rows, so both follow from the number of rows alone.
    """
    n = F.col("_n_rows")
    head = F.least(n, F.lit(rows - 1))
    tail = n - head
    total = head * (head + 1) / 2 + tail * rows
    squares = head * (head + 1) * (2 * head + 1) / 6 + tail * rows * rows
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))))
    return (
        cells.groupBy("_key").agg(F.sum("_rows").alias("_n_rows"))
        .select("_key", (total / n).alias("avg_count"), spread.alias("std_count"))
    )


def _add_row_bursts(positioned: DataFrame, cells: DataFrame, threshold: float, rows: int) -> DataFrame:
    limits = _burst_limits(cells, rows)
    recent = F.least(F.col("_pos") + 1, F.lit(rows))
    return join_small(positioned.withColumn("recent_count", recent), limits, "_key").withColumn(
        "is_burst", fn.above(F.col("recent_count"), F.col("avg_count") + threshold * F.col("std_count")))


def row_bursts(df: DataFrame, threshold: float = 2.0, rows: int = BURST_ROWS) -> DataFrame:
    """Burst flag on a frame of the last ``rows`` rows. A frame of fixed row count cannot exceed its own
    mean by two deviations, so at the default threshold no row is ever flagged; see ``time_bursts``."""
    cells = materialize(per_second(df, LOG_ORDER))
    positioned = with_position(df, LOG_ORDER, cells=cells)
    return _add_row_bursts(positioned, cells, threshold, rows).drop("_key", "_sec", "_pos")


def time_bursts(df: DataFrame, seconds: int = 300, threshold: float = 2.0,
                order: RowOrder = LOG_ORDER) -> DataFrame:
    """Burst flag on the trailing ``seconds``: count above mean + ``threshold`` deviations of its key."""
    cells = materialize(
        over_trailing(per_second(df, order), {"recent_count": Trailing("sum", seconds, "_rows")}))
    weight, count = F.col("_rows"), F.col("recent_count")
    means = cells.groupBy("_key").agg((F.sum(weight * count) / F.sum(weight)).alias("avg_count"))
    gap = count - F.col("avg_count")
    spread = join_small(cells, means, "_key").groupBy("_key").agg(
        F.first("avg_count").alias("avg_count"),
        F.when(F.sum(weight) > 1, F.sqrt(F.sum(weight * gap * gap) / (F.sum(weight) - 1))).alias("std_count"),
    )
    cells = join_small(cells, spread, "_key").withColumn(
        "is_burst", fn.above(count, F.col("avg_count") + threshold * F.col("std_count")))
    return attach_cells(df, cells, order)


def group_spread(df: DataFrame, by: str, column: str) -> DataFrame:
    """Mean and sample deviation of a column over the whole group, on every row; null is a group."""
    stats = df.groupBy(by).agg(F.avg(column).alias(f"{column}_mean"), F.stddev_samp(column).alias(f"{column}_std"))
    return join_small(df, stats, by, null_safe=True)


def build_enriched(logs: DataFrame, threshold: float = 2.0, slice_rows: int | None = None) -> DataFrame:
    """The whole enrichment. Like the feature table it shuffles the rows twice."""
    cells = materialize(hourly_cells(logs))
    positioned = with_position(status_features(logs), LOG_ORDER, cells=cells)
    arrived = _add_arrival(positioned, slice_rows)
    return _add_row_bursts(arrived, cells, threshold, BURST_ROWS).drop("_key", "_sec", "_pos")

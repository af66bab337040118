"""A stored table of mergeable sketches per (hour, log type), and summaries of any range merged from it.

Quantiles come from KLL sketches, distinct users from HyperLogLog sketches, counts and moments are exact. A range of
days is answered from its hours' rows - some kilobytes each - without reading a log row again; late hours are merged by
adding rows. Streams write the same table, so their distinct users merge as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch: ranks are right to about 2.3 / K ** 0.9; of the user sketch: to about 1.04 / 2 ** (LG / 2).
K, LG = 400, 12
RANK_ERROR, USER_ERROR = 0.02, 0.05


def sketch_table(logs: DataFrame, value: str = "response_time_ms", user: str = "user_id") -> DataFrame:
    """hour, log_type, row_count, value_count, value_sum, value_sketch, user_sketch."""
    x = F.col(value).cast("double")
    return logs.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour"), "log_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(x).alias("value_count"), F.sum(x).alias("value_sum"),
        F.kll_sketch_agg_double(x, F.lit(K)).alias("value_sketch"), F.hll_sketch_agg(user, F.lit(LG)).alias("user_sketch"))


def merged(sketches: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Sketch rows combined by the given expressions over hour and log_type; the same columns, so they merge further."""
    return sketches.groupBy(*[c.alias(n) for n, c in by.items()]).agg(
        F.sum("row_count").alias("row_count"), F.sum("value_count").alias("value_count"), F.sum("value_sum").alias("value_sum"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"), F.hll_union_agg("user_sketch").alias("user_sketch"))


def estimates(sketches: DataFrame, probability: float = 0.95) -> DataFrame:
    """The rows with ``value_mean``, ``value_quantile`` (estimated) and ``distinct_users`` (estimated)."""
    some = F.col("value_count") > 0
    return sketches.withColumns({
        "value_mean": F.try_divide("value_sum", "value_count"),
        "value_quantile": F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(probability))),
        "distinct_users": F.hll_sketch_estimate("user_sketch")}).drop("value_sketch", "user_sketch")

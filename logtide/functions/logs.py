"""Row-level expressions over log columns; all of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.schemas import LOG_LEVELS

# Fixed value: the status pattern, a free-standing three-digit number.
STATUS_PATTERN = r"\b(\d{3})\b"


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """1 = Sunday … 7 = Saturday."""
    return F.dayofweek(ts)


def is_weekend(ts: Column) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), 1).otherwise(0)


def is_business_hours(ts: Column) -> Column:
    """Hours 9 to 17, both included."""
    return F.when(F.hour(ts).between(9, 17), 1).otherwise(0)


def level_code(level: Column) -> Column:
    """DEBUG 0 … CRITICAL 4, null for anything else."""
    codes = F.create_map(*[F.lit(x) for i, name in enumerate(LOG_LEVELS) for x in (name, i)])
    return codes[level]


def status_text(message: Column) -> Column:
    """First free-standing three-digit number of the message, else the empty string."""
    return F.regexp_extract(message, STATUS_PATTERN, 1)


def is_error_status(status: Column) -> Column:
    return F.when(status.try_cast("int") >= 400, 1).otherwise(0)


def api_response_time(log_type: Column, response_time: Column) -> Column:
    return F.when(log_type == "API_REQUEST", response_time)


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Standard score; 0 without a value or without spread."""
    return F.when(value.isNotNull() & (std > 0), (value - mean) / std).otherwise(0.0)


def above(value: Column, limit: Column) -> Column:
    return F.when(value > limit, 1).otherwise(0)


def is_seasonal_anomaly(value: Column, mean: Column, std: Column, threshold: float = 3.0) -> Column:
    """True when the value lies more than ``threshold`` deviations off its history; false without spread."""
    return F.when(std == 0, False).otherwise(F.abs(F.try_divide(value - mean, std)) > threshold)


def entropy_bits(counts: list[Column], total: Column) -> Column:
    """Shannon entropy in bits of a split of ``total`` into ``counts``."""
    terms = [
        F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts
    ]
    result = terms[0]
    for term in terms[1:]:
        result = result + term
    return result


def array_entropy_bits(values: Column) -> Column:
    """Shannon entropy in bits of the values of an array; 0 for an empty one.

    One pass over the sorted array adds ``c * log2(c)`` for every run of c equal values.
    """
    n = F.size(values)

    def closed(state: Column) -> Column:
        return state["done"] + F.when(state["run"] > 0, state["run"] * F.log2(state["run"])).otherwise(0.0)

    def step(state: Column, value: Column) -> Column:
        same = value.eqNullSafe(state["value"])
        return F.struct(
            value.alias("value"),
            F.when(same, state["run"] + 1).otherwise(1.0).alias("run"),
            F.when(same, state["done"]).otherwise(closed(state)).alias("done"),
        )

    start = F.struct(F.get(values, F.lit(-1)).alias("value"), F.lit(0.0).alias("run"), F.lit(0.0).alias("done"))
    total = F.aggregate(F.sort_array(values), start, step, closed)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.log2(n) - total / n))


def severity(score: Column, cuts: tuple[tuple[str, float], ...] = (("critical", 0.95), ("high", 0.8),
                                                                  ("medium", 0.6))) -> Column:
    """Severity tier of a score: first tier whose cut it exceeds, else ``low``."""
    tier = None
    for name, cut in cuts:
        tier = F.when(score > cut, name) if tier is None else tier.when(score > cut, name)
    return tier.otherwise("low")

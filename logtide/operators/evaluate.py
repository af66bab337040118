"""Model quality against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.plans.quantiles import exact_quantile


def _cells(actual: str, predicted: str):
    a, p = F.col(actual).cast("int") == 1, F.col(predicted).cast("int") == 1
    return {"tp": a & p, "fp": ~a & p, "fn": a & ~p, "tn": ~a & ~p}


def evaluate(df: DataFrame, actual: str = "is_anomaly_actual", predicted: str = "is_anomaly_predicted",
             by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1, each 0 where undefined, from one aggregation."""
    counts = df.groupBy(*(by or [])).agg(
        *[F.count_if(c).alias(n) for n, c in _cells(actual, predicted).items()],
        F.count(F.lit(1)).alias("dataset_size"),
    )

    def share(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1_score": share(2 * tp, 2 * tp + fp + fn),
    })


def confusion_matrix(df: DataFrame, actual: str = "is_anomaly_actual",
                     predicted: str = "is_anomaly_predicted") -> DataFrame:
    """All four cells, also empty ones: ``actual``, ``predicted``, ``count``."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in _cells(actual, predicted).items()])
    return counts.select(F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, count)"))


def metric_rows(metrics: DataFrame, names: tuple[str, ...] = ("precision", "recall", "f1_score")) -> DataFrame:
    """One row per metric: every other column is kept beside ``metric_name`` and ``metric_value``."""
    keep = [c for c in metrics.columns if c not in names and c not in ("tp", "fp", "fn", "tn")]
    return metrics.unpivot(keep, list(names), "metric_name", "metric_value")


def holdout_split(df: DataFrame, share: float = 0.8, key: str = "log_id") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by hash of the key: the same rows in every run."""
    bucket = F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000)
    return df.filter(bucket), df.filter(~bucket)


def time_split(df: DataFrame, share: float = 0.8, time: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows up to the time that ``share`` of the rows do not exceed, and the rows after it, for series whose
    neighbours belong together. Rows without a time count as early."""
    moment = F.unix_micros(F.col(time).cast("timestamp"))
    cut = exact_quantile(df.select(moment.alias("t")), "t", share, discrete=True).first()
    if cut is None:
        return df, df.limit(0)
    late = F.coalesce(moment > F.lit(int(cut["quantile"])), F.lit(False))
    return df.filter(~late), df.filter(late)

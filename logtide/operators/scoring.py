"""Feature vectors, scaling, score normalisation and the combined anomaly flag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_vector(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    """The listed columns as one array of doubles, missing values as 0."""
    return df.withColumn(name, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature is divided by 1."""

    features: list[str]
    means: list[float]
    stds: list[float]

    def scaled(self) -> list[Column]:
        """One column per feature: missing values become 0, then (x - mean) / std."""
        return [
            ((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / (s or 1.0)).alias(c)
            for c, m, s in zip(self.features, self.means, self.stds)
        ]

    def vector(self, name: str = "features") -> Column:
        return F.array(*self.scaled()).alias(name)


def fit_scaler(df: DataFrame, features: list[str]) -> Scaler:
    """One aggregation over all features; two numbers per feature reach the driver."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    row = df.agg(
        F.array(*[F.avg(c) for c in filled]).alias("means"),
        F.array(*[F.stddev_pop(c) for c in filled]).alias("stds"),
    ).first()
    if row["means"][:1] == [None]:
        raise ValueError("cannot fit a scaler on an empty table")
    return Scaler(list(features), list(row["means"]), list(row["stds"]))


def scale(df: DataFrame, scaler: Scaler, keep: list[str]) -> DataFrame:
    return df.select(*keep, *scaler.scaled())


def min_max(df: DataFrame, score: str, name: str, invert: bool = False, epsilon: float = 0.0,
            bounds: tuple[float, float] | None = None) -> DataFrame:
    """Score scaled to 0…1 over the table, or over given ``bounds``; ``invert`` turns 1 into the lowest.

    Minimum and maximum come in as one scalar subquery, so ``df`` is read twice: hand in a stored table
    when the score is costly. Without spread the result is 0.
    """
    if bounds is None:
        both = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
        low, high = both["lo"], both["hi"]
    else:
        low, high = F.lit(bounds[0]), F.lit(bounds[1])
    share = F.try_divide(F.col(score) - low, high - low + F.lit(epsilon))
    if invert:
        share = 1 - share
    return df.withColumn(name, F.when(F.col(score).isNull(), None).when(high == low, 0.0).otherwise(share))


def prediction_from_decision(decision: Column) -> Column:
    """1 for a negative decision value, else 0."""
    return (decision < 0).cast("int")


def attach_scores(df: DataFrame, scores: DataFrame, key: str = "log_id") -> DataFrame:
    """Left join of an external score table on the row key."""
    return df.join(scores, key, "left")


def combine_scores(df: DataFrame, weights: dict[str, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """``combined_score``: weighted mean of the scores a row has, 0 without any; flag above ``threshold``."""
    weights = weights or {"if_score": 1.0}
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    combined = F.when(weight > 0, total / weight).otherwise(0.0)
    return (
        df.withColumn("combined_score", combined)
        .withColumn("is_anomaly_predicted", F.when(F.col("combined_score") > threshold, 1).otherwise(0))
    )


def result_columns(scored: DataFrame) -> DataFrame:
    return scored.select("log_id", "timestamp", "log_type", "message", "combined_score", "is_anomaly_predicted",
                         F.col("is_anomaly").alias("is_anomaly_actual"))


def predicted_anomalies(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("is_anomaly_predicted") == 1)


def anomaly_rows(scored: DataFrame, model_name: str = "ensemble", model_version: str = "v1.0") -> DataFrame:
    """Flagged rows as a batch for the anomaly table."""
    return predicted_anomalies(scored).select(
        "log_id", "timestamp", "log_level", "log_type", "message",
        F.col("combined_score").alias("anomaly_score"),
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.lit("{}").alias("features"),
    )


def top_anomalies(scored: DataFrame, n: int = 10) -> DataFrame:
    return (
        predicted_anomalies(scored).orderBy(F.desc("combined_score"), "log_id").limit(n)
        .select("log_id", "timestamp", "log_type", "message", "combined_score")
    )


def run_summary(scored: DataFrame) -> DataFrame:
    """Rows, predicted anomalies and their percentage."""
    anomalies = F.coalesce(F.sum(F.col("is_anomaly_predicted")), F.lit(0)).cast("long")
    return scored.agg(
        F.count(F.lit(1)).alias("total"), anomalies.alias("anomalies"),
        F.coalesce(F.try_divide(anomalies * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("anomaly_percent"),
    )

"""Data quality, model monitoring, feature statistics and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.operators.evaluate import evaluate
from logtide.plans.materialize import materialize
from logtide.plans.ordering import RowOrder, with_position
from logtide.plans.quantiles import column_quantiles


def quality_checks(logs: DataFrame) -> DataFrame:
    """One row per rule - not empty, unique ``log_id``, no missing timestamp - with its verdict."""
    per_id = logs.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("timestamp").isNull()).alias("without_time"))
    found = per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("copies"),
        F.coalesce(F.sum("without_time"), F.lit(0)).alias("without_time"),
    )
    return found.selectExpr(
        "stack(3, 'not_empty', rows, rows > 0, 'unique_log_id', copies, copies = 0,"
        " 'timestamp_present', without_time, without_time = 0) AS (check_name, observed, passed)"
    )


def require_quality(logs: DataFrame) -> None:
    """Raise when a quality rule fails."""
    failed = [r["check_name"] for r in quality_checks(logs).filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"quality checks failed: {', '.join(failed)}")


def recent_metrics(performance: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Metrics of the last ``days``, newest first."""
    since = as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (
        performance.filter(F.col("evaluation_date") > since)
        .orderBy(F.desc("evaluation_date"), "model_name", "metric_name")
        .select("model_name", "metric_name", "metric_value", "evaluation_date")
    )


def quality_warnings(performance: DataFrame, as_of: Column, days: int = 7, metric: str = "f1_score",
                     floor: float = 0.7) -> DataFrame:
    """Recent values of ``metric`` under the floor."""
    return recent_metrics(performance, as_of, days).filter(
        (F.col("metric_name") == metric) & (F.col("metric_value") < floor))


def feature_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, deviation, minimum, maximum and exact 95th percentile per feature; all features share the passes."""
    df = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in features]))
    p95 = column_quantiles(df, features, 0.95).select(
        F.col("column_name").alias("feature_name"), F.col("value").alias("stat_value"))
    aggs, parts = [], []
    for c in features:
        value = F.col(c).cast("double")
        for stat, column in {
            "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value),
        }.items():
            aggs.append(column.alias(f"{c}|{stat}"))
            parts.append(f"'{c}', '{stat}', `{c}|{stat}`")
    wide = df.agg(F.count(F.lit(1)).alias("sample_size"), *aggs)
    simple = wide.selectExpr(
        "sample_size", f"stack({len(parts)}, {', '.join(parts)}) AS (feature_name, stat_type, stat_value)")
    names = simple.filter("stat_type = 'mean'").select("feature_name", "sample_size")  # also features without values
    ranked = names.join(F.broadcast(p95), "feature_name", "left").withColumn("stat_type", F.lit("percentile_95"))
    columns = ["feature_name", "stat_type", "stat_value", "sample_size"]
    return simple.select(*columns).unionByName(ranked.select(*columns))


def drift(previous: DataFrame, current: DataFrame, max_shift: float = 0.5) -> DataFrame:
    """Change of each feature between two statistics tables: relative change of the mean, and its shift
    in previous deviations; ``drifted`` when the shift exceeds ``max_shift``."""
    def wide(stats: DataFrame, prefix: str) -> DataFrame:
        return stats.groupBy("feature_name").agg(
            F.max(F.when(F.col("stat_type") == "mean", F.col("stat_value"))).alias(f"{prefix}_mean"),
            F.max(F.when(F.col("stat_type") == "std", F.col("stat_value"))).alias(f"{prefix}_std"),
        )

    both = wide(previous, "previous").join(wide(current, "current"), "feature_name")
    change = F.col("current_mean") - F.col("previous_mean")
    return both.withColumns({
        "relative_change": F.try_divide(change, F.abs("previous_mean")),
        "shift": F.try_divide(change, F.col("previous_std")),
    }).withColumn("drifted", F.coalesce(F.abs("shift") > max_shift, F.lit(False)))


def feature_effect(scored: DataFrame, features: list[str], score: str) -> DataFrame:
    """Correlation of each feature with the score, strongest first."""
    wide = scored.agg(*[F.corr(F.col(c).cast("double"), score).alias(c) for c in features])
    parts = ", ".join(f"'{c}', `{c}`" for c in features)
    return (
        wide.selectExpr(f"stack({len(features)}, {parts}) AS (feature_name, correlation)")
        .orderBy(F.desc_nulls_last(F.abs("correlation")), "feature_name")
    )


def permutation_importance(df: DataFrame, features: list[str], predict, label: str, key: str = "log_id") -> DataFrame:
    """feature_name, f1_score (all features in place), permuted_f1_score, loss: what F1 a model loses when the values of
    one feature are dealt to other rows.

    ``predict`` adds a 0/1 column ``prediction`` to a frame with the features. The permutation is a join of two row
    orders, by MD5 of the key alone and with the feature's name, numbered without gathering (``plans.ordering``), so it
    repeats on any cluster and needs no list of the rows.
    """
    rows = materialize(df.select(key, label, *features))

    def positions(salt: str, *columns: str) -> DataFrame:
        digest = F.md5(F.concat_ws("/", F.lit(salt), F.col(key).cast("string")).cast("binary"))
        placed = rows.select(*columns, digest.alias("_md5")).withColumn(
            "_time", F.timestamp_seconds(F.conv(F.substring("_md5", 1, 7), 16, 10).cast("long")))
        return with_position(placed, RowOrder(None, "_time", "_md5")).select(*columns, "_pos")

    base = materialize(positions("rows", key))
    scores = evaluate(predict(rows), label, "prediction").select(F.lit("").alias("feature_name"), F.col("f1_score").alias("s"))
    for c in features:
        dealt = base.join(positions(c, c), "_pos").drop("_pos")
        permuted = rows.drop(c).join(dealt, key)
        scores = scores.unionByName(evaluate(predict(permuted), label, "prediction").select(
            F.lit(c).alias("feature_name"), F.col("f1_score").alias("s")))
    found = {r["feature_name"]: r["s"] for r in scores.collect()}  # one row for each feature
    whole = found.pop("")
    return df.sparkSession.createDataFrame(
        [(c, whole, s, whole - s) for c, s in found.items()],
        "feature_name string, f1_score double, permuted_f1_score double, loss double")

"""Distribution drift between two tables: Kolmogorov-Smirnov distance and population stability index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize
from logtide.plans.quantiles import exact_quantiles

#: Ranges that a feature's values are cut into; a plan setting.
PARTS = 64
#: Equal shares of the previous values that the stability index compares, and the least share that counts.
BINS, LEAST_SHARE = 10, 1e-4


def _melted(df: DataFrame, features: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    return df.selectExpr(f"stack({len(features)}, {pairs}) AS (feature_name, value)").filter("value is not null")


def _both(previous: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature_name, value, before, after): how often a value occurs in either table, combined map-side."""
    one = F.lit(1).cast("long")
    rows = _melted(previous, features).select("*", one.alias("before"), F.lit(0).cast("long").alias("after")).unionByName(
        _melted(current, features).select("*", F.lit(0).cast("long").alias("before"), one.alias("after")))
    return rows.groupBy("feature_name", "value").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


def ks_distance(previous: DataFrame, current: DataFrame, features: list[str], parts: int = PARTS) -> DataFrame:
    """feature_name, previous_rows, current_rows, ks: the largest distance of the two cumulative shares.

    Distinct values are dealt to ranges of about equal size, whose totals are carried to the ranges behind; within a
    range the counts run on. So no task holds a feature's values, and all features share the passes.
    """
    counts = materialize(_both(previous, current, features))
    grid = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = counts.groupBy("feature_name").agg(F.percentile_approx("value", grid, 1000).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("value")))
    dealt = join_small(counts, cuts, "feature_name").withColumn("_part", part).drop("_cuts")
    totals = dealt.groupBy("feature_name", "_part").agg(F.sum("before").alias("_b"), F.sum("after").alias("_a"))
    ahead = Window.partitionBy("feature_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature_name")
    carried = totals.select(  # at most ``parts`` rows for each feature
        "feature_name", "_part", F.coalesce(F.sum("_b").over(ahead), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_a").over(ahead), F.lit(0)).alias("_after"), F.sum("_b").over(whole).alias("previous_rows"),
        F.sum("_a").over(whole).alias("current_rows"))
    inside = Window.partitionBy("feature_name", "_part").orderBy("value")
    running = join_small(dealt, carried, ["feature_name", "_part"]).select(
        "feature_name", "previous_rows", "current_rows",
        F.abs((F.col("_before") + F.sum("before").over(inside)) / F.col("previous_rows")
              - (F.col("_after") + F.sum("after").over(inside)) / F.col("current_rows")).alias("_gap"))
    return running.groupBy("feature_name", "previous_rows", "current_rows").agg(F.max("_gap").alias("ks"))


def stability_index(previous: DataFrame, current: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """feature_name, psi: sum of (q - p) ln(q / p) over ``bins`` ranges between quantiles of the previous values.

    A share below ``LEAST_SHARE`` counts as that. Equal quantiles make one range.
    """
    counts = materialize(_both(previous, current, features))
    wanted = {f"q{k}": k / bins for k in range(1, bins)}
    edges = exact_quantiles(_melted(previous, features), "value", wanted, ["feature_name"], discrete=True)
    edges = edges.select("feature_name", F.array_distinct(F.array(*wanted)).alias("_edges"))
    dealt = join_small(counts, edges, "feature_name").withColumn(
        "_bin", F.size(F.filter("_edges", lambda e: e < F.col("value"))))
    shares = dealt.groupBy("feature_name", "_bin").agg(F.sum("before").alias("_b"), F.sum("after").alias("_a"))
    whole = Window.partitionBy("feature_name")
    p = F.greatest(F.col("_b") / F.sum("_b").over(whole), F.lit(LEAST_SHARE))
    q = F.greatest(F.col("_a") / F.sum("_a").over(whole), F.lit(LEAST_SHARE))
    return shares.withColumn("_x", (q - p) * F.log(q / p)).groupBy("feature_name").agg(F.sum("_x").alias("psi"))


def distribution_drift(previous: DataFrame, current: DataFrame, features: list[str], max_ks: float = 0.1,
                       max_psi: float = 0.2) -> DataFrame:
    """``ks_distance`` and ``stability_index`` side by side, and ``drifted`` where one of them passes its limit."""
    both = ks_distance(previous, current, features).join(stability_index(previous, current, features), "feature_name")
    return both.withColumn("drifted", (F.col("ks") > max_ks) | (F.col("psi") > max_psi))

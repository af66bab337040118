"""Isolation forest: sampling and scoring over the whole table, trees grown on executors.

A tree sees at most 256 rows by definition of the method, so the forest itself is small whatever the
table holds. Rows are drawn by hash, which repeats under any partitioning. The finished trees - at most
``trees * (2 * samples - 1)`` node rows - travel to the scoring tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.operators.scoring import Scaler, fit_scaler, min_max, prediction_from_decision
from logtide.plans.materialize import materialize
from logtide.plans.quantiles import exact_quantile
from logtide.schemas import FOREST_FEATURES

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double, sampled int"


@dataclass(frozen=True)
class ForestModel:
    scaler: Scaler
    nodes: pd.DataFrame
    offset: float
    low: float
    high: float


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _unit_hash(*columns: Column) -> Column:
    """Number in [0, 1) from all 53 bits that a double holds: shares may be near 1e-9."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(2 ** 53)


def _md5_share(*columns: Column) -> Column:
    """The same from 52 bits of MD5, for draws that other engines must repeat."""
    digest = F.md5(F.concat_ws("/", *[c.cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2 ** 52)


def draw_samples(df: DataFrame, rows: int, trees: int, samples: int, seed: int, key: str = "log_id",
                 unit=_unit_hash) -> DataFrame:
    """(tree, row) pairs, at most ``samples`` per tree, from one pass over ``df``.

    Every (tree, row) pair is drawn on its own, by a hash of both (``unit``), inside the row: what leaves the pass is
    about 1.5 * ``trees`` * ``samples`` rows whatever the table holds, and any row may get into any tree.
    """
    share = min(1.0, (1.5 * samples + 50) / rows) if rows > samples else 1.0

    def draw(tree):
        return unit(F.col(key), tree, F.lit(seed))

    order = Window.partitionBy("tree").orderBy("draw", key)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: draw(tree) < share)
    return (
        df.withColumn("tree", F.explode(drawn)).withColumn("draw", draw(F.col("tree")))
        .withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= samples)
    )


def _grow(seed: int):
    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        data = np.stack(group.sort_values("pick")["features"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(data), 2)))
        out: list[list] = []
        waiting = [(0, np.arange(len(data)), 0)]
        out.append([])
        while waiting:
            node, rows, depth = waiting.pop()
            low, high = data[rows].min(axis=0), data[rows].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(usable) == 0:
                out[node] = [tree, node, 0, 0.0, node, node, depth + mean_path(len(rows)), len(data)]
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            goes_left = data[rows, feature] <= cut
            left, right = len(out), len(out) + 1
            out += [[], []]
            out[node] = [tree, node, feature, cut, left, right, 0.0, len(data)]
            waiting += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "left", "right", "path", "sampled"])

    return grow


def grow_forest(samples: DataFrame, seed: int) -> DataFrame:
    """Node table of all trees from sampled rows (``tree``, ``pick``, ``features``)."""
    return samples.select("tree", "pick", "features").groupBy("tree").applyInPandas(_grow(seed), NODE_SCHEMA)


def forest_score(nodes: pd.DataFrame, features: Column) -> Column:
    """Anomaly score ``2^(-E[path] / c)`` of a scaled feature vector, evaluated on Arrow batches."""
    trees = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    roots = np.cumsum([0, *map(len, trees)])[:-1]
    flat = pd.concat(trees, ignore_index=True)
    base = np.repeat(roots, [len(g) for g in trees])
    inner = (flat["left"] != flat["right"]).to_numpy()
    feature = flat["feature"].to_numpy(np.int32)
    # a leaf sends every row to itself, so that all rows of a batch take the same steps
    threshold = np.where(inner, flat["threshold"], np.inf)
    left = (flat["left"].to_numpy() + base).astype(np.int32)
    right = (flat["right"].to_numpy() + base).astype(np.int32)
    path = flat["path"].to_numpy()
    norm = mean_path(float(nodes["sampled"].max())) or 1.0
    depth = math.ceil(math.log2(max(float(nodes["sampled"].max()), 2)))
    both = np.stack([left, right], axis=1).ravel()

    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype="float64")
                continue
            data = np.stack(batch.to_numpy())
            data = np.where(np.isnan(data), np.inf, data)  # goes right at every cut, and stays in a leaf
            width, cells = data.shape[1], np.ascontiguousarray(data).ravel()
            line = np.arange(len(data), dtype=np.int32) * width
            total = np.zeros(len(data))
            for root in roots.tolist():
                at = np.full(len(data), root, np.int32)
                for _ in range(depth):
                    above = cells.take(line + feature.take(at)) > threshold.take(at)
                    at = both.take(2 * at + above)
                total += path.take(at)
            yield pd.Series(np.exp2(-total / len(roots) / norm))

    walk.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(walk, "double")(features)


def fit_forest(df: DataFrame, features: list[str] | None = None, trees: int = 100, samples: int = 256,
               contamination: float = 0.05, seed: int = 42, key: str = "log_id") -> ForestModel:
    """Scale, sample, grow, score the training rows and set the offset at the contamination percentile."""
    return fit_and_score_forest(df, features, trees, samples, contamination, seed, key)[0]


def fit_and_score_forest(df: DataFrame, features: list[str] | None = None, trees: int = 100, samples: int = 256,
                         contamination: float = 0.05, seed: int = 42, key: str = "log_id") -> tuple[ForestModel, DataFrame]:
    """The model, and its training rows as ``score_forest`` scores them: ``key``, if_decision, if_prediction, if_score.

    The fit needs the scores of the training rows for its offset; they are kept, so no row is scored twice.
    """
    features = features or [c for c in FOREST_FEATURES if c in df.columns]
    scaler = fit_scaler(df, features)
    rows = df.count()
    vectors = df.select(key, scaler.vector())
    nodes = grow_forest(draw_samples(vectors, rows, trees, samples, seed, key), seed).toPandas()
    scores = materialize(vectors.select(key, (-forest_score(nodes, F.col("features"))).alias("raw")))
    offset = exact_quantile(scores, "raw", contamination, name="offset").first()["offset"]
    span = scores.agg(F.min("raw").alias("low"), F.max("raw").alias("high")).first()
    model = ForestModel(scaler, nodes, float(offset), span["low"] - offset, span["high"] - offset)
    decided = scores.select(key, (F.col("raw") - F.lit(model.offset)).alias("if_decision"))
    return model, min_max(decided.withColumn("if_prediction", prediction_from_decision(F.col("if_decision"))),
                          "if_decision", "if_score", invert=True, bounds=(model.low, model.high))


def score_forest(df: DataFrame, model: ForestModel, relative_to_training: bool = False) -> DataFrame:
    """Add ``if_decision``, ``if_prediction`` and ``if_score`` (1 = most anomalous).

    By default the score is relative to the rows at hand: a first pass over the model's columns finds the
    range. ``relative_to_training`` uses the range seen in training: comparable between runs, one pass.
    """
    decision = -forest_score(model.nodes, F.col("_features")) - F.lit(model.offset)

    def decide(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_features", model.scaler.vector()).withColumn("if_decision", decision).drop("_features")

    decided, bounds = decide(df), (model.low, model.high)
    if not relative_to_training:
        # two numbers: a second walk over the model's columns costs less than storing the whole wide table
        span = decide(df.select(*model.scaler.features)).agg(
            F.min("if_decision").alias("low"), F.max("if_decision").alias("high")).first()
        bounds = (span["low"], span["high"]) if span["low"] is not None else (0.0, 0.0)
    return min_max(
        decided.withColumn("if_prediction", prediction_from_decision(F.col("if_decision"))),
        "if_decision", "if_score", invert=True, bounds=bounds,
    )


def save_forest(spark: SparkSession, model: ForestModel, path: str) -> None:
    """Model tables: nodes, and one row per feature with the scaler and the model constants."""
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    s = model.scaler
    rows = [(i, f, m, d, model.offset, model.low, model.high) for i, (f, m, d) in enumerate(zip(s.features, s.means, s.stds))]
    spark.createDataFrame(
        rows, "position int, feature string, mean double, std double, offset double, low double, high double"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_forest(spark: SparkSession, path: str) -> ForestModel:
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toPandas()
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    scaler = Scaler([r["feature"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows])
    return ForestModel(scaler, nodes, rows[0]["offset"], rows[0]["low"], rows[0]["high"])

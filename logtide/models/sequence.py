"""Sequences of consecutive log rows, and their reconstruction error as an anomaly score.

A linear autoencoder (principal components of the flattened sequences) stands in for a recurrent one:
fit on sequences, mean squared reconstruction error, threshold at the 95th percentile. Sequences
overlap in all but one row, so they are never stored: slices of the ordered rows carry the few rows
behind them, and each task forms its sequences as views.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.operators.scoring import Scaler, fit_scaler, min_max
from logtide.plans.materialize import materialize
from logtide.plans.ordering import RowOrder, with_position, with_slices
from logtide.plans.quantiles import exact_quantile
from logtide.schemas import SEQUENCE_FEATURES

#: One global series; ``RowOrder()`` gives one series per log type.
GLOBAL_ORDER = RowOrder(key=None)
#: Rows per task group, and sequences expanded at a time inside it.
GROUP_ROWS = 65_536
CHUNK = 4_096


def sequences(df: DataFrame, columns: list[str], length: int = 50, label: str = "is_anomaly",
              order: RowOrder = GLOBAL_ORDER, slice_rows: int = GROUP_ROWS) -> DataFrame:
    """All runs of ``length`` consecutive rows: first and last row key, the label (1 if any row is
    anomalous) and the steps as an array of arrays."""
    ahead = Window.partitionBy("_key", "_slice").orderBy("_pos").rowsBetween(0, length - 1)
    step = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return (
        with_slices(with_position(df, order), after=length - 1, slice_rows=slice_rows)
        .withColumns({
            "_steps": F.count(F.lit(1)).over(ahead),
            "last_id": F.last(order.tie).over(ahead),
            "sequence_label": F.max(F.col(label).cast("int")).over(ahead),
            "steps": F.collect_list(step).over(ahead),
        })
        .filter(F.col("_own") & (F.col("_steps") == length))
        .select(*([order.key] if order.key else []), F.col("_pos").alias("position"),
                F.col(order.tie).alias("first_id"), "last_id", "sequence_label", "steps")
    )


@dataclass(frozen=True)
class SequenceModel:
    scaler: Scaler
    length: int
    mean: np.ndarray
    components: np.ndarray
    threshold: float


def _slices(df: DataFrame, scaler: Scaler, length: int, label: str | None, order: RowOrder,
            slice_rows: int) -> DataFrame:
    flag = F.coalesce(F.col(label).cast("int"), F.lit(0)) if label and label in df.columns else F.lit(0)
    key = [c for c in (order.key,) if c]
    slim = df.select(*key, order.time, order.tie, flag.alias("_label"), scaler.vector("_vector"))
    placed = with_slices(with_position(slim, order), after=length - 1, slice_rows=slice_rows)
    return placed.select("_key", "_slice", "_pos", "_own", F.col(order.tie).alias("_id"), "_label", "_vector")


def _windows(group: pd.DataFrame, length: int) -> tuple[pd.DataFrame, np.ndarray | None]:
    """The group in row order, and its sequences as an (n, length, features) view starting at own rows.

    Own rows come first in a slice; the copies behind them only complete the last sequences."""
    group = group.sort_values("_pos")
    own = int(group["_own"].sum())
    steps = np.stack(group["_vector"].to_numpy())
    count = min(own, len(steps) - length + 1)
    if count <= 0:
        return group, None
    view = np.lib.stride_tricks.sliding_window_view(steps, length, axis=0)[:count]
    return group, view.transpose(0, 2, 1)


def _chunks(view: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, len(view), CHUNK):
        part = view[start:start + CHUNK]
        yield part.reshape(len(part), -1)


def _whole_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices out of batches of a partition that is sorted by slice; one slice and one batch are held."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for _, part in batch.groupby(["_key", "_slice"], sort=False):
            if held and (held[0]["_key"].iloc[0], held[0]["_slice"].iloc[0]) != (
                    part["_key"].iloc[0], part["_slice"].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _moments(length: int, size: int):
    """Second moments of all sequences of a partition: one matrix per task, however many slices it reads."""
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, total, count = np.zeros((size, size)), np.zeros(size), 0
        for group in _whole_slices(batches):
            _, view = _windows(group, length)
            if view is None:
                continue
            for flat in _chunks(view):
                gram += flat.T @ flat
                total += flat.sum(axis=0)
            count += len(view)
        if count:
            i, j = np.triu_indices(size)
            yield pd.DataFrame({
                "i": np.concatenate([i, np.full(size, -1), [-1]]).astype("int32"),
                "j": np.concatenate([j, np.arange(size), [-1]]).astype("int32"),
                "v": np.concatenate([gram[i, j], total, [float(count)]]),
            })

    return moments


def _errors(length: int, mean: np.ndarray, components: np.ndarray):
    def errors(group: pd.DataFrame) -> pd.DataFrame:
        group, view = _windows(group, length)
        if view is None:
            return pd.DataFrame({"position": [], "first_id": [], "sequence_label": [], "error": []}).astype(
                {"position": "int64", "first_id": "str", "sequence_label": "int32", "error": "float64"})
        found = []
        for flat in _chunks(view):
            centred = flat - mean
            rest = centred - (centred @ components) @ components.T
            found.append((rest ** 2).mean(axis=1))
        count = len(view)
        labels = np.lib.stride_tricks.sliding_window_view(group["_label"].to_numpy(), length)[:count].max(axis=1)
        return pd.DataFrame({
            "position": group["_pos"].to_numpy()[:count], "first_id": group["_id"].to_numpy()[:count],
            "sequence_label": labels.astype("int32"), "error": np.concatenate(found),
        })

    return errors


def _score_slices(slices: DataFrame, length: int, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    return slices.groupBy("_key", "_slice").applyInPandas(
        _errors(length, mean, components), "position long, first_id string, sequence_label int, error double")


def fit_sequences(df: DataFrame, features: list[str] | None = None, length: int = 50, components: int = 64,
                  label: str = "is_anomaly", order: RowOrder = GLOBAL_ORDER,
                  slice_rows: int = GROUP_ROWS) -> SequenceModel:
    """Fit on all sequences. Tasks add up second moments; only their sum, a square matrix of
    ``length * len(features)`` columns, reaches the driver for its eigenvectors."""
    return fit_and_score_sequences(df, features, length, components, label, order, slice_rows)[0]


def fit_and_score_sequences(
        df: DataFrame, features: list[str] | None = None, length: int = 50, components: int = 64,
        label: str = "is_anomaly", order: RowOrder = GLOBAL_ORDER,
        slice_rows: int = GROUP_ROWS) -> tuple[SequenceModel, DataFrame]:
    """The fitted model and its scores of the training rows, which share positions, slices and errors."""
    features = features or [c for c in SEQUENCE_FEATURES if c in df.columns]
    scaler = fit_scaler(df, features)
    slices = materialize(_slices(df, scaler, length, label, order, slice_rows))
    sums = (
        slices.repartition("_key", "_slice").sortWithinPartitions("_key", "_slice")
        .mapInPandas(_moments(length, length * len(features)), "i int, j int, v double")
        .groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    )
    if sums.empty:
        raise ValueError(f"fewer than {length} rows in every series")
    size = length * len(features)
    count = float(sums.loc[(sums.i == -1) & (sums.j == -1), "v"].iloc[0])
    mean = np.zeros(size)
    edge = sums[(sums.i == -1) & (sums.j >= 0)]
    mean[edge.j.to_numpy()] = edge.v.to_numpy() / count
    gram = np.zeros((size, size))
    body = sums[sums.i >= 0]
    gram[body.i.to_numpy(), body.j.to_numpy()] = body.v.to_numpy()
    gram = gram + np.triu(gram, 1).T
    values, vectors = np.linalg.eigh(gram / count - np.outer(mean, mean))
    top = vectors[:, np.argsort(values)[::-1][:min(components, size)]]
    scored = materialize(_score_slices(slices, length, mean, top))
    threshold = exact_quantile(scored, "error", 0.95, name="threshold").first()["threshold"]
    model = SequenceModel(scaler, length, mean, top, float(threshold))
    return model, _flagged(scored, model)


def score_sequences(df: DataFrame, model: SequenceModel, label: str = "is_anomaly",
                    order: RowOrder = GLOBAL_ORDER, slice_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per sequence: start position and row, label, ``error``, ``prediction``, ``score`` in 0…1."""
    slices = _slices(df, model.scaler, model.length, label, order, slice_rows)
    return _flagged(materialize(_score_slices(slices, model.length, model.mean, model.components)), model)


def _flagged(scored: DataFrame, model: SequenceModel) -> DataFrame:
    flagged = scored.withColumn("prediction", (F.col("error") > model.threshold).cast("int"))
    return min_max(flagged, "error", "score", epsilon=1e-8)


def save_sequences(spark: SparkSession, model: SequenceModel, path: str) -> None:
    s = model.scaler
    scaler = [(i, f, m, d, model.length, model.threshold) for i, (f, m, d) in enumerate(zip(s.features, s.means, s.stds))]
    spark.createDataFrame(
        scaler, "position int, feature string, mean double, std double, length int, threshold double"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    basis = [(i, float(m), [float(x) for x in row]) for i, (m, row) in enumerate(zip(model.mean, model.components))]
    spark.createDataFrame(basis, "position int, mean double, loadings array<double>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/basis")


def load_sequences(spark: SparkSession, path: str) -> SequenceModel:
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    basis = spark.read.parquet(f"{path}/basis").orderBy("position").collect()
    scaler = Scaler([r["feature"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows])
    return SequenceModel(scaler, rows[0]["length"], np.array([b["mean"] for b in basis]),
                         np.array([b["loadings"] for b in basis]), rows[0]["threshold"])

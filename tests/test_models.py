"""Forest and sequence model: repeatability, quality, equality with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.models import forest, sequence
from logtide.operators.scoring import fit_scaler
from logtide.plans.ordering import RowOrder


@pytest.fixture(scope="module")
def planted(spark):
    """2,000 rows, 40 of them far out."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(2000, 3))
    points[:40] += rng.choice([-6, 6], size=(40, 3))
    rows = [(f"r{i:05d}", *map(float, p), i < 40) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "log_id string, a double, b double, c double, is_anomaly boolean").repartition(4)


def test_mean_path():
    assert [forest.mean_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert forest.mean_path(256) == pytest.approx(10.244, abs=1e-3)


def test_samples_are_bounded_and_repeatable(spark, planted):
    vectors = planted.select("log_id", F.array("a", "b", "c").alias("features"))
    drawn = forest.draw_samples(vectors, 2000, 10, 64, 1)
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 64 and min(sizes) >= 50
    again = forest.draw_samples(vectors.repartition(9), 2000, 10, 64, 1)
    key = ("tree", "log_id", "pick")
    assert sorted(drawn.select(*key).collect()) == sorted(again.select(*key).collect())


def test_forest_finds_planted_rows(spark, planted):
    model = forest.fit_forest(planted, ["a", "b", "c"], trees=50, contamination=0.02)
    scored = forest.score_forest(planted, model).toPandas()
    order = scored["if_score"].rank()
    auc = (order[scored.is_anomaly].sum() - 40 * 41 / 2) / (40 * 1960)
    assert auc > 0.97
    assert scored["if_score"].min() == 0.0 and scored["if_score"].max() == 1.0
    assert scored["if_prediction"].sum() == 40
    assert set(scored.loc[scored.if_prediction == 1, "if_decision"] < 0) == {True}


def test_forest_is_repeatable(spark, planted):
    one = forest.fit_forest(planted, ["a", "b", "c"], trees=5)
    two = forest.fit_forest(planted.repartition(7), ["a", "b", "c"], trees=5)
    key = ["tree", "node"]
    left, right = (m.nodes.sort_values(key).reset_index(drop=True) for m in (one, two))
    assert np.allclose(left.to_numpy(dtype=float), right.to_numpy(dtype=float))
    assert left.groupby("tree").size().max() <= 2 * 256 - 1


def test_forest_score_equals_a_walk_by_hand(spark, planted):
    model = forest.fit_forest(planted, ["a", "b", "c"], trees=3)
    nodes = {(r.tree, r.node): r for r in model.nodes.itertuples()}
    rows = planted.select("log_id", model.scaler.vector()).limit(20)
    got = {r["log_id"]: (r["s"], r["features"]) for r in rows.withColumn(
        "s", forest.forest_score(model.nodes, F.col("features"))).collect()}
    for score, vector in got.values():
        paths = []
        for tree in range(3):
            node = nodes[tree, 0]
            while node.left != node.node:
                node = nodes[tree, node.left if vector[node.feature] <= node.threshold else node.right]
            paths.append(node.path)
        assert score == pytest.approx(2 ** (-np.mean(paths) / forest.mean_path(256)))


def series(spark, n=120):
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(n) / 3) + rng.normal(size=n) * 0.05
    x[70:71] = 8.0
    rows = [(f"r{i:04d}", i, float(x[i]), float(x[i] * 2 + rng.normal() * 0.01), i == 70) for i in range(n)]
    df = spark.createDataFrame(rows, "log_id string, i long, x double, y double, is_anomaly boolean")
    return df.withColumn("timestamp", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 7).cast("timestamp_ntz"))


@pytest.mark.parametrize("slice_rows", [13, 65_536])
def test_sequence_errors_equal_brute_force(spark, slice_rows):
    df = series(spark)
    model = sequence.fit_sequences(df, ["x", "y"], length=6, components=3, slice_rows=slice_rows)
    got = sequence.score_sequences(df, model, slice_rows=slice_rows).orderBy("position").toPandas()

    data = df.orderBy("i").toPandas()
    scaler = fit_scaler(df, ["x", "y"])
    z = (data[["x", "y"]].to_numpy() - np.array(scaler.means)) / np.array(scaler.stds)
    flat = np.stack([z[i:i + 6].ravel() for i in range(len(z) - 5)])
    centred = flat - flat.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    rest = centred - centred @ vt[:3].T @ vt[:3]
    errors = (rest ** 2).mean(axis=1)
    assert got["error"].to_numpy() == pytest.approx(errors, rel=1e-6)
    assert model.threshold == pytest.approx(np.percentile(errors, 95), rel=1e-6)
    assert got["sequence_label"].tolist() == [int(65 <= i <= 70) for i in range(115)]
    assert got["first_id"].tolist() == [f"r{i:04d}" for i in range(115)]
    assert got["prediction"].sum() == 6 and got["score"].max() == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_sequences_per_key(spark, slice_rows):
    df = series(spark, 40).withColumn("log_type", F.when(F.col("i") % 4 == 0, "B").otherwise("A"))
    got = sequence.sequences(df, ["x"], 5, order=RowOrder("log_type"), slice_rows=slice_rows)
    assert {r["log_type"]: r["count"] for r in got.groupBy("log_type").count().collect()} == {"A": 26, "B": 6}
    first = got.filter("log_type = 'B' AND position = 2").first()
    assert (first["first_id"], first["last_id"], len(first["steps"])) == ("r0008", "r0024", 5)


def test_too_few_rows(spark):
    df = series(spark, 4)
    assert sequence.sequences(df, ["x"], 5).count() == 0
    with pytest.raises(ValueError):
        sequence.fit_sequences(df, ["x"], length=5)

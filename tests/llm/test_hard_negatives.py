import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import hard_negatives as hard
from logtide.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows):
    """The query's rows from all pairs."""
    kept = {}
    for i, v, label in rows:
        if label is not None and v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = ([math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = []
    for a, (v, label) in kept.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (w, other) in kept.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits[:3])]
    return sorted(out)


def vectors(seed, n, width=12, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    made = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, width))
    made *= rng.choice([0.01, 0.3, 1.0, 4.0], (n, 1))
    return [(k, [float(x) for x in v], int(c)) for k, (v, c) in enumerate(zip(made, rng.integers(0, 3, n)))]


def odd_rows():
    return [(9_000, None, 1), (9_001, [1.0] * 12, None), (9_002, [math.nan] + [0.0] * 11, 1), (9_050, [math.inf] * 12, 1),
            (9_100, [0.0] * 12, 1), (9_150, [1.0, 2.0], 2), (9_151, [0.0] * 12, 1), (9_200, [], 1), (None, [1.0] * 12, 1)]


def save(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_query_equals_all_pairs(spark, tmp_path):
    rows = vectors(1, 700) + odd_rows() + [(10_000 + k, [0.5] * 12, k % 2) for k in range(120)]  # many ties
    found = QUERIES["op12_hard_negatives"](spark, save(spark, tmp_path, rows)).collect()
    wanted = slow(rows)
    assert sorted(map(tuple, found)) == wanted and len(wanted) > 60


@pytest.mark.parametrize("count, most", [(0, 100), (1, 64), (8, 50)])
def test_plan_settings_do_not_matter(spark, monkeypatch, count, most):
    monkeypatch.setattr(hard, "LEAST_BLOCK", 16)
    monkeypatch.setattr(hard, "SLICE", 2)
    rows = vectors(2, 500, spread=0.15)
    table = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    made = hard.prepare(table, label, hard.quantised("embedding", 256), hard.finite("embedding"), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, hard.hard_negatives(made, count=count, most=most).collect())) == slow(rows)


def test_intervals_hold_and_leave_rows_out():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 16))
    whole = np.floor(200 * (centres[rng.integers(0, 4, 400)] + 0.1 * rng.normal(size=(400, 16)))).astype(np.int64)
    refs = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    made = hard.Vectors.unpack(hard.Vectors.make(np.arange(400), np.zeros(400, int), whole, refs).pack())
    block, kept = hard.Block(made), 0
    for k in range(0, 400, 9):
        exact = block.rows.whole @ made.whole[k]
        low, high = float(np.sort(exact)[-20]), float(exact.max())
        at = block.near(made.angles[k].astype(float), float(made.norms[k]), low, high)
        assert set(np.flatnonzero((exact >= low) & (exact <= high))) <= set(at)
        kept += len(at)
    assert kept < 0.6 * 400 * 45


def test_large_integers_are_exact_or_refused(spark):
    def rows(x):
        made = [(k, [x + k, x - k, 3], k % 2, k == 0) for k in range(6)]
        return spark.createDataFrame(made, "vec_id long, v array<long>, label long, anchor boolean")

    found = hard.hard_negatives(rows(10 ** 9), low=0, high=200).collect()
    assert {(r["positive_id"], r["positive_score"]) for r in found} == {(k, 2 * 10 ** 18 + 9) for k in (2, 4)}
    assert {(r["negative_id"], r["rank"]) for r in found} == {(1, 1), (3, 2), (5, 3)}
    with pytest.raises(Exception, match="64 bits"):
        hard.hard_negatives(rows(2 ** 31)).collect()


def test_repeated_ids_and_empty_tables(spark):
    table = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [0.95], 2)], SCHEMA)

    def run(t):
        return hard.hard_negatives(hard.prepare(t, F.col("label"), hard.quantised("embedding", 10), hard.finite("embedding"),
                                                F.col("vec_id") == 0)).collect()

    assert [tuple(r) for r in run(table)] == [(0, 1, 1, 2, 100, 90)]
    assert run(table.limit(0)) == [] and run(table.filter("vec_id > 0")) == []

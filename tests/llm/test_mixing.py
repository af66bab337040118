import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logtide.llm import mixing
from logtide.llm.queries import QUERIES


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if out[s] > most * sizes[s]}
        if not over - full:
            return out
        full |= over


def corpus(rng, n, sources):
    return [(k, " ".join(["w"] * max(0, int(rng.lognormvariate(4, 1.2)))), None, rng.choice(sources))
            for k in range(n)]


def test_query_meets_its_targets(spark, saved):
    rng = random.Random(5)
    rows = corpus(rng, 3000, [None, "", "a", "b", "c", "d"]) + [(9000, None, None, "z"), (9001, "tiny doc", None, "Ä")]
    rows += corpus(rng, 2000, ["hot"])
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    folder = saved(rows)
    got = QUERIES["op6_mixing"](spark, folder).collect()
    again = QUERIES["op6_mixing"](spark, folder).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again} and len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    sizes = Counter()
    for k, s in source.items():
        sizes[s] += words[k]
    wanted, taken = targets(sizes), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(wanted[s])
        assert r["taken"] in [c * r["size"] for c in range(4)]
        assert r["size"] == 0 or abs(r["taken"] / r["size"] - wanted[s] / sizes[s]) < 1 + 1e-9
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= max(0.01 * wanted[s], 150), (s, taken[s], wanted[s])


def test_expectations_are_kept(spark, table):
    """Over many sources alike, every document, large or small, is taken as often as its target says."""
    sizes, alike = [40, 13, 9, 5, 3, 1], 300
    rows = [(10 * s + k, " ".join(["w"] * n), None, f"{s:04d}") for s in range(2 * alike) for k, n in enumerate(sizes)]
    sums, rates = Counter(), {}
    for r in mixing.mix(table(rows), weights=(1.0, 3.0)).collect():
        kind = (r["doc_id"] // 10 % 2, r["doc_id"] % 10)
        sums[kind] += r["copies"]
        rate = rates[kind] = r["target"] / r["source_size"]
        assert int(rate) <= r["copies"] <= int(rate) + 1
    assert set(rates.values()) == {0.5, 1.5}
    for kind, rate in rates.items():
        assert abs(sums[kind] / alike - rate) < 4 * 0.5 / alike ** 0.5, (kind, sums[kind] / alike, rate)


def test_odd_rows(spark, table):
    same = [(1, "one two three", "en", "a")] * 40 + [(1, "one two three", "de", "a")] * 3
    rows = same + [(None, "x y", None, None), (2, None, None, "b"), (3, " \t\n", None, "b")]
    df = table(rows).withColumns({"size": F.lit("x"), "target": F.lit("y"), "copies": F.lit(1)})
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and {r["taken"] for r in got if r["source"] == "b"} == {0}
    taken = mixing.take_mix(df)
    assert taken.columns == df.columns
    total = sum(r["copies"] for r in got)
    assert taken.count() == total
    want = Counter({k: 0 for k in [r["doc_id"] for r in got]})
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in taken.collect()) == +want
    assert mixing.mix(table(rows).limit(0)).count() == 0 and mixing.take_mix(table(rows).limit(0)).count() == 0
    assert mixing.mix(table([(1, None), (2, "")])).filter("taken <> 0").count() == 0

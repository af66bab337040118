import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import line_quality
from logtide.llm.queries import QUERIES, labels


def enumerate_chain(emit, follow):
    """Probability of bad per line, transition sums and log partition from all labellings."""
    weights = {}
    for y in itertools.product((0, 1), repeat=len(emit)):
        weights[y] = np.exp(sum(e * a for e, a in zip(emit, y)) + sum(follow[a, b] for a, b in zip(y, y[1:])))
    total, pairs = sum(weights.values()), np.zeros((2, 2))
    bad = [sum(w for y, w in weights.items() if y[k]) / total for k in range(len(emit))]
    for y, w in weights.items():
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w / total
    return bad, pairs, np.log(total)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 6, 3, 1, 8, 2])
    emit, follow = rng.normal(0, 2, sizes.sum()), rng.normal(0, 1, (2, 2))
    field = line_quality.LineField(np.zeros(line_quality.FEATURES), follow, (0, 0))
    bad, pairs, total = field.marginals(emit, sizes)
    at, wanted = 0, np.zeros((2, 2))
    for k, n in enumerate(sizes):
        b, p, t = enumerate_chain(emit[at:at + n], follow)
        assert bad[at:at + n] == pytest.approx(b) and total[k] == pytest.approx(t)
        wanted += p
        at += n
    assert pairs == pytest.approx(wanted)


def test_long_chains_do_not_overflow():
    field = line_quality.LineField(np.zeros(line_quality.FEATURES), np.array([[3.0, -3], [-3, 3]]), (0, -1))
    bad = field.marginals(np.full(100_000, 50.0), np.array([100_000]))[0]
    assert np.isfinite(bad).all() and bad.min() > 0.99


def test_neighbours_decide_unclear_lines():
    """The same line is bad among bad lines and good among good ones."""
    rng, texts, good = random.Random(2), [], []
    for k in range(200):
        plain = " ".join(rng.choices(["some", "plain", "words", "of", "text"], k=12))
        junk = " ".join(w + "$$$" for w in rng.choices("abcdef", k=12))
        good.append(k % 2)
        texts.append("\n".join([plain, plain + " more", plain] if k % 2 else [junk, junk + "!", junk]))
    made = [line_quality.line_features(t) for t in texts]
    sizes = np.array([len(x) for _, x in made])
    field = line_quality.fit_lines(np.concatenate([f for f, _ in made]), np.concatenate([x for _, x in made]), sizes,
                                   np.array(good))
    f, _ = line_quality.line_features("some plain words\n?\nof text here")
    g, _ = line_quality.line_features("a$$$ b$$$ c$$$\n?\nd$$$ e$$$ f$$$")
    one = field.marginals(f @ field.weights, np.array([3]))[0][1]
    other = field.marginals(g @ field.weights, np.array([3]))[0][1]
    assert one < 0.5 < other
    assert field.follow[0, 0] + field.follow[1, 1] > field.follow[0, 1] + field.follow[1, 0]


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    result = QUERIES["op9_quality"](spark, folder).cache()
    got = result.join(labels(spark, folder), "doc_id").collect()
    assert result.count() == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.98


def test_held_out_labels_change_nothing(spark, table):
    rows = [(k, "plain words of text\n" * 3 if k % 2 else "a$$$ b$$$ c$$$\n" * 3) for k in range(90)]
    docs = table(rows).cache()
    given = [(k, k % 2, 0) for k in range(90)]
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q, t) for k, q, t in given]
    scores = []
    for these in (given, turned):
        frame = spark.createDataFrame(these, "doc_id long, quality int, toxic int")
        field = line_quality.fit(docs, line_quality.learning_labels(frame))
        scores.append({r["doc_id"]: r["score"] for r in line_quality.score_documents(docs, field).collect()})
    assert scores[0] == scores[1] and all((scores[0][k] > 0.5) == (k % 2 == 1) for k in range(90))


def test_odd_rows(spark, table):
    rows = [(None, "x"), (1, None), (2, ""), (3, "\n\n"), (4, "word " * 100_000), (5, "é"), (6, "a b"), (6, "a b"), (7, "\x00")]
    df = table(rows).withColumns({"score": F.lit("mine"), "good": F.lit(1)})
    some = spark.createDataFrame([(1, None, 0), (None, 1, 0), (5, 1, 0), (6, 0, 1), (6, 1, 1), (4, 7, 0), (99, 1, 0)],
                                 "doc_id long, quality int, toxic int")
    field = line_quality.fit(df, some)
    got = line_quality.score_documents(df, field).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert set(got[0].asDict()) == set(df.columns)
    kept = line_quality.keep_good(df, line_quality.fit(df, some.limit(0)))
    assert kept.columns == df.columns and kept.count() == len(rows) and kept.first()["score"] == "mine"
    assert line_quality.score_documents(df.limit(0), field).count() == 0
    assert line_quality.fit(df.limit(0), some).curve == (0.0, 0.0)


def test_bad_lines_late_in_a_text_are_learnt(spark, table):
    """Documents are fitted on whole: what makes them bad comes after line 200."""
    plain, junk = "plain words of a text", "x$$$ y$$$ z$$$ w$$$"
    rows = [(k, "\n".join([plain] * 250 + ([plain] * 40 if k % 2 else [junk] * 40))) for k in range(40)]
    given = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    field = line_quality.fit(table(rows), given)
    scores = field.score([t for _, t in rows])
    assert all((s >= 0.5) == (k % 2 == 1) for k, s in enumerate(scores))


def test_whole_documents_are_drawn(spark, table):
    assert line_quality.draw_whole([(1, 5), (2, 7), (3, 4), (4, 1)], 10) == [1, 3, 4]
    rows = [(k, "\n".join(["a line"] * (k + 1))) for k in range(30)]
    given = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    sizes = [len(r["lengths"]) for r in line_quality.training_lines(table(rows), given, lines=100, longest=20).collect()]
    assert sum(sizes) <= 100 and max(sizes) <= 20 and len(set(sizes)) == len(sizes) > 3

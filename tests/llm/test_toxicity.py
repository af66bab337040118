import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import toxicity
from logtide.llm.queries import QUERIES

BAD = ["vilefo", "grumpit", "snarkle"]


def corpus(n, seed=1):
    """Toxic texts hold words that begin like three stems, a third of them with signs for letters."""
    rng, rows, marks = random.Random(seed), [], []
    plain = ["".join(rng.choices("abcdeghlmnorstu", k=rng.randint(2, 8))) for _ in range(400)]
    for k in range(n):
        words = rng.choices(plain, k=rng.randint(8, 120))
        if k % 5 == 0:
            for _ in range(rng.randint(2, 5)):
                bad = rng.choice(BAD) + "".join(rng.choices("aeiou", k=rng.randint(0, 4)))
                words.insert(rng.randrange(len(words)), bad)
                words.insert(rng.randrange(len(words)), "you")
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(k % 5 == 0)))
    return rows, marks


def save(spark, table, tmp_path, rows, marks):
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_held_out_texts_with_unseen_words(spark, table, tmp_path):
    rows, marks = corpus(900)
    rows += [(901, None), (902, ""), (903, "x " * 60_000), (None, rows[0][1]), rows[1], rows[1]]
    found = QUERIES["op13_toxicity"](spark, save(spark, table, tmp_path, rows, marks)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert 150 < len(held) < 300
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[901]["score"] == by_id[902]["score"] < 0.3 and by_id[None]["score"] == by_id[0]["score"]


def test_labels_of_held_out_rows_do_not_matter(spark, table, tmp_path):
    rows, marks = corpus(200)
    first = {r["doc_id"]: r["score"] for r in QUERIES["op13_toxicity"](
        spark, save(spark, table, tmp_path / "a", rows, marks)).collect()}
    held = {r["doc_id"] for r in QUERIES["op13_toxicity"](spark, str(tmp_path / "a")).filter("held_out").collect()}
    other = [(k, q, 1 - t if k in held else t) for k, q, t in marks]
    again = QUERIES["op13_toxicity"](spark, save(spark, table, tmp_path / "b", rows, other)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == first


def slow_isotonic(y):
    """Least squares of a non-decreasing sequence, by the mean of every stretch."""
    return [max(min(np.mean(y[a:b + 1]) for b in range(k, len(y))) for a in range(k + 1)) for k in range(len(y))]


def test_isotonic_curve():
    rng = np.random.default_rng(2)
    raw = np.sort(rng.normal(size=40))
    y = (rng.random(40) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    knots, values = toxicity.isotonic(raw, y)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    fitted = slow_isotonic(y)
    assert sorted(set(np.round(fitted, 12))) == pytest.approx(sorted(set(np.round(values, 12))))


def test_trees_split_and_predict_alike():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 4)), 1)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0)).astype(float)
    model = toxicity.grow(x, y, trees=60)
    assert np.mean((model.raw(x) > 0) == (y == 1)) > 0.97
    one = toxicity.grow(x[:, :1], (x[:, 0] > 0.5).astype(float), trees=1)
    node, left = one.cuts[0, 0], x[:, 0] <= one.cuts[0, 0]
    assert one.features[0, 0] == 0 and 0.4 <= node <= 0.6 and set((x[left, 0] > 0.5)) == {False}


def test_features_of_a_text():
    lexicon = toxicity.Lexicon({"vil~": 5.0, "grime": 2.5})
    row = dict(zip(toxicity.FEATURES, toxicity.text_features("You VILE man! gr1me v.i.l.e soooo so so?", lexicon)))
    assert row["log_words"] == pytest.approx(np.log1p(8)) and row["strong"] == 2 / 8 and row["weak"] == 3 / 8
    assert row["hidden"] == 2 / 8 and row["hidden_hits"] == 2 / 8 and row["stretched"] == 1 / 8
    assert row["close_share"] == 1 and row["closeness"] == 0.5 and row["shouted"] == 1 / 8
    assert row["exclamations"] == row["questions"] == 1 / 8 and row["different"] == pytest.approx(np.log1p(2))
    assert not toxicity.text_features(None, lexicon).any() and not toxicity.text_features(" \n", lexicon).any()


@pytest.mark.parametrize("marks, share", [([(1, 1, 0)], 0.0), ([(1, 1, 1)], 1.0), ([], 0.0), ([(1, 1, None)], 0.0)])
def test_labels_of_one_kind(spark, table, marks, share):
    docs = table([(1, "a"), (2, None)]).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score_documents(docs, model, ("doc_id", "lang")).collect()
    assert {r["score"] for r in found} == {share} and toxicity.score_documents(docs.limit(0), model).count() == 0


def test_copies_do_not_displace_other_texts(spark, table):
    rows = [(k, "same text") for k in range(300)] + [(300 + k, f"text {k}") for k in range(40)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(340)], "doc_id long, quality int, toxic int")
    found = toxicity.training_texts(table(rows), labels, sample=1000).collect()
    assert len(found) == 41 and {r["label"] for r in found if r["text"] == "same text"} == {1}


def test_a_token_is_described_once(monkeypatch):
    """Tokens of further texts cost a lookup; what is kept is bounded and changes no feature."""
    asked, texts = [], ["You vile v.i.l.e man, grime!", "man, you VILE so sooo vile. v.i.l.e", "sooo man, grime! you"] * 3
    plain = [toxicity.text_features(t, toxicity.Lexicon({"vil~": 5.0, "grime": 2.5})).tolist() for t in texts]
    whole = toxicity.Lexicon.describe
    monkeypatch.setattr(toxicity.Lexicon, "describe", lambda self, t: (asked.append(t), whole(self, t))[1])
    lexicon = toxicity.Lexicon({"vil~": 5.0, "grime": 2.5})
    assert [toxicity.text_features(t, lexicon).tolist() for t in texts] == plain
    assert 0 < len(asked) < 20 and max(asked.count(t) for t in asked) <= 4
    monkeypatch.setattr(toxicity, "KEPT", 1)
    assert [toxicity.text_features(t, lexicon).tolist() for t in texts] == plain

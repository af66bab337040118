"""The pipeline against a plain Python version, stage by stage, and on odd tables."""

import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import line_quality
from logtide.llm.queries import piece_model
from test_similar import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fold_text(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture
def folder(spark, table, tmp_path):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ing", "ther", "st", "ou", "wa") for b in ("le", "nd", "er", "on", "ti", "mo")]
    rows = []
    for k in range(160):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(rng.randint(1, 4)))
        if k % 8 == 7:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((k, text, "en", rng.choice(["a", "b", "c", None])))
    for k in range(160, 220):
        text = rng.choice(rows[:160])[1]
        rows.append((k, text if k % 2 else text.capitalize() + (" tail" if k % 3 else ""), "en", "a"))
    rows += [(220, None, None, None), (221, "", "en", "b"), (222, " ".join(rng.choices(words, k=30_000)), "en", "c")]
    rows += [(223, rows[222][1] + " tail", "en", "c")]
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(k, int(k % 8 != 7), 0) for k in range(160)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run_equals_plain_python(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    frame, given = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == COLUMNS
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        given[name] = [tuple(r) for r in frame.collect()]
    # quality: whole documents stay or go, by the score of the field; the clean ones stay
    field = line_quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), line_quality.learning_labels(
        spark.read.parquet(f"{folder}/labels.parquet")))
    good = [d for d in docs if field.score([d[1]])[0] >= 0.5]
    assert sorted(given["quality"], key=str) == sorted(good, key=str)
    ids = {d[0] for d in good}
    assert {k for k in range(160) if k % 8 != 7} <= ids and not {k for k in range(160) if k % 8 == 7} & ids
    # exact duplicates
    best = {}
    for d in good:
        best[fold_text(d[1])] = max(best.get(fold_text(d[1]), d), d, key=lambda x: x[0])
    assert sorted(given["exact_dedup"]) == sorted(best.values())
    # near-duplicates
    kept = sorted(best.values())
    label = components([d[:2] for d in kept])
    first = [d for d in kept if d[0] == label[d[0]]]
    assert sorted(given["near_dedup"]) == first and len(first) < len(kept)
    # mixing: copies of whole documents near the targets
    counts = Counter(given["mixing"])
    assert set(counts) <= set(first) and max(counts.values()) <= 3
    sizes, taken = Counter(), Counter()
    for d in first:
        sizes[d[3]] += len((d[1] or "").split())
    for d, n in counts.items():
        taken[d[3]] += n * len((d[1] or "").split())
    from test_mixing import targets
    wanted = targets(sizes)
    for s in sizes:  # one document of 30,000 words is most of its source: no mix comes nearer than that
        largest = max(len((d[1] or "").split()) for d in first if d[3] == s)
        assert abs(taken[s] - wanted[s]) <= min(largest, max(0.02 * wanted[s], 150) if largest < 1000 else largest)
    # tokens, over the whole run
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    result = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in result) == Counter(d[0] for d in given["mixing"])
    text = {d[0]: d[1] or "" for d in docs}
    for r in result:
        assert r["ids"] == library.encode(text[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ends"][-1] == len(text[r["doc_id"]].encode()) and r["n_tokens"] == len(r["ids"])


def test_each_stage_on_odd_tables(spark, table, folder):
    rows = [(None, None, None, None), (None, "a b c d", None, None), (1, "a b c d", "en", "s"), (1, "a b c d", "en", "s"),
            (2, "A B C D", "de", None), (3, "", "en", ""), (4, "x " * 50_000, "en", "s")]
    odd = table(rows).withColumns({"score": F.lit(1), "_hash": F.lit("x"), "size": F.lit(2), "root": F.lit("r"), "_doc": F.lit(5)})
    for name, stage in corpus_pipeline.STAGES:
        some = stage(spark, odd, folder).cache()
        assert some.count() >= 1, name
        if name != "tokens":
            assert some.columns == odd.columns
            assert all((r["score"], r["_hash"], r["_doc"]) == (1, "x", 5) for r in some.collect())
        assert stage(spark, odd.limit(0), folder).count() == 0, name

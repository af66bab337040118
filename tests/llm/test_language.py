import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import language
from logtide.llm.queries import QUERIES, documents


def slow_bits(text, counts, order):
    """Code length by walking down the contexts byte by byte."""
    total, kinds = Counter(), Counter()
    for g, n in counts.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    bits = 0.0
    for k in range(len(text)):
        for size in range(min(order, k), -1, -1):
            context = text[k - size:k]
            if not total[context]:
                continue
            n = counts.get(context + text[k:k + 1], 0)
            if n:
                bits += math.log2((total[context] + kinds[context]) / n)
                break
            bits += math.log2((total[context] + kinds[context]) / kinds[context])
        else:
            bits += 8
    return bits


def grams(texts, order):
    out = Counter()
    for t in texts:
        out.update(t[k:k + n] for n in range(1, order + 2) for k in range(len(t) - n + 1))
    return dict(out)


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_code_lengths_equal_the_definition(order, monkeypatch):
    monkeypatch.setattr(language, "_CHUNK", 50)
    rng = random.Random(order)
    counts = {"x": grams([b"banana bandana", b"abracadabra"], order), "y": grams(["ñandú año".encode(), b"nab"], order)}
    model = language.ContextTrees.from_counts(counts, order)
    texts = [bytes(rng.choices(b"abndr \xc3\xb1zq\0", k=rng.randint(0, 300))) for _ in range(40)] + [b"", b"a"]
    got = model.code_lengths(texts)
    for text, row in zip(texts, got):
        assert row == pytest.approx([slow_bits(text, counts[lang], order) for lang in model.languages], rel=1e-5)


def test_counts_equal_brute_force(spark):
    rows = [("x", "abcab"), ("x", "bé"), ("y", "abc"), ("y", ""), ("x", "abcab")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = defaultdict(dict)
    for r in language.count_grams(df, 3).collect():
        got[r["lang"]][language._gram(r["gram"])] = r["n"]
    for lang in "xy":
        assert got[lang] == grams([t.encode() for k, t in rows if k == lang], 3)


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op5_language_id"](spark, folder).join(documents(spark, folder), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98


def test_what_is_learnt_leaves_held_out_labels_alone(spark, table):
    rows = [(k, "aaa bbb aab", "l1") if k % 2 else (k, "xyz zzy yyx", "l2") for k in range(60)]
    held = {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    wrong = [(k, t, "poison" if k in held else lang) for k, t, lang in rows]
    got = language.learn_and_predict(table([(*r, None) for r in wrong])).collect()
    assert {r["lang_pred"] for r in got} == {"l1", "l2"}


def test_odd_rows(spark, table):
    rows = [(None, "aaa", "l1"), (1, None, "l1"), (2, "", "l1"), (3, "12 ½ ²", "l1"), (4, "bbb" * 70_000, "l2"), (5, "é", None),
            (6, "aab", "l1"), (6, "aab", "l1"), (8, "bba", "l2")]
    df = table([(*r, None) for r in rows]).withColumns({"lang_pred": F.lit("x"), "score": F.lit(1), "_share": F.lit(1)})
    got = language.learn_and_predict(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and by[4]["lang_pred"] == "l2"
    assert by[6]["lang_pred"] == "l1" and by[None]["held_out"] is False
    assert language.learn_and_predict(df.limit(0)).count() == 0
    nothing = language.learn_and_predict(table([(1, "abc"), (2, "abd")])).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_copies_do_not_displace_other_texts(spark, table):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(["ab", "cad", "bee", "dae", "fab"], k=12)), "en", None) for k in range(50)]
    copies = [(100 + k, "zz yy zz", "en", None) for k in range(600)]
    once = language.fit(table(rows + copies[:1]), docs_per_language=60)
    often = language.fit(table(rows + copies), docs_per_language=60)
    assert np.array_equal(once.cost, often.cost) and np.array_equal(once.escape, often.escape)
    assert once.symbol[ord("z")] and once.symbol[ord("f")]


def test_every_string_of_the_drawn_texts_is_in_the_model(spark, table):
    """Many languages: totals and escapes are those of whole trees, and shorter contexts hold where room is short."""
    rng = random.Random(8)
    rows = [(40 * k + j, " ".join("".join(rng.choices(f"abcdefgh{chr(97 + k)}", k=5)) for _ in range(30)), f"l{k:02d}", None)
            for k in range(12) for j in range(5)]
    model = language.fit(table(rows))
    counts = {f"l{k:02d}": grams([t.encode() for _, t, lang, _ in rows if lang == f"l{k:02d}"], 3) for k in range(12)}
    whole = language.ContextTrees.from_counts(counts, 3)
    assert model.order == 3 and np.array_equal(model.cost, whole.cost) and np.array_equal(model.escape, whole.escape)
    strings = {k: len({g for own in counts.values() for g in own if len(g) <= k}) for k in (1, 2, 3)}
    small = language.fit(table(rows), cells=12 * strings[2])
    shorter = language.ContextTrees.from_counts(
        {lang: {g: n for g, n in own.items() if len(g) <= 2} for lang, own in counts.items()}, 1)
    assert small.order == 1 and np.array_equal(small.cost, shorter.cost)
    assert language.fit(table(rows), cells=1).order == 0


def test_the_sample_is_bounded_over_all_languages(spark, table, monkeypatch):
    rows = [(k, f"text number {k}", f"l{k % 50}", None) for k in range(1000)]
    seen = []
    whole = language.count_grams
    monkeypatch.setattr(language, "count_grams", lambda docs, order: (seen.append(docs.count()), whole(docs, order))[1])
    language.fit(table(rows), sample=200)
    assert 120 < seen[0] < 290

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logtide.llm import merkle
from logtide.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(text):
    lines, phrases = [], set()
    for p in text.split("\n"):
        own = [sha(u) for u in re.findall(merkle.PHRASE, p)]
        phrases.update(d[:16] for d in own)
        lines.append(sha("p" + "".join(own)))
    sections = [""]
    for d in lines:
        sections[-1] += d + ","
        if d[0] in "01" or d == sha("p"):
            sections.append("")
    sections = [s for s in sections if s]
    return sha("r" + "".join(sha("s" + s) for s in sections)), phrases, [s.split(",")[:-1] for s in sections]


def places(a, b):
    """Places of the paragraphs of differing sections of ``a`` that no differing section of ``b`` has."""
    odd = [(i, s) for i, s in enumerate(a) if s not in b and s not in a[:i]]
    known = {d for s in b if s not in a for d in s}
    out = []
    for i, s in odd:
        for j, d in enumerate(s):
            if d not in known:
                known.add(d)
                out.append(f"{i}:{j}")
    return ",".join(out)


def like(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_query_equals_brute_force(spark, saved, parts):
    rng = random.Random(6)
    words = ["alpha", "ß", "𝒳y", "gamma,", "d" * 90, "", "é"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 9)))
             for _ in range(70)]
    rows = [(k * 3 - 50, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, "x"), (903, texts[5])]
    rows += [(904, "word " * 60_000), (-900, "last one")]
    by = sorted(rows, key=lambda r: -r[0])
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r["doc_id"]: r for r in QUERIES["op8_document_fingerprints"](spark, saved(rows)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(by):
        text, after = text or "", by[(k + 1) % len(by)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert r["fingerprint"] == tree(text)[0] and r["edited_fingerprint"] == tree(edited)[0]
        assert r["near_edited"] == pytest.approx(like(tree(text)[1], tree(edited)[1]), abs=1e-8)
        own, other = tree(text)[2], tree(edited)[2]
        assert (r["removed"], r["added"]) == (places(own, other), places(other, own))
        assert r["near_next"] == pytest.approx(like(tree(text)[1], tree(after)[1]), abs=1e-8)


def test_all_differing_branches_are_located(spark):
    lines = [f"line {k} of the text" for k in range(60)]
    rows = []
    for n, at in enumerate([(0,), (17,), (3, 41), (5, 6, 33, 59), ()]):
        changed = [f"something else {k}" if k in at else line for k, line in enumerate(lines)]
        rows.append((n, list(at), "\n".join(lines), "\n".join(changed)))
    rows.append((9, [], "\n".join(lines), "\n".join([*lines[:20], "put in", *lines[20:]])))
    df = spark.createDataFrame(rows, "n int, at array<int>, a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a", "a_"), "b", "b_")
    df = df.withColumn("removed", merkle.changes(F.col("a_sections"), F.col("b_sections"))).withColumn(
        "added", merkle.changes(F.col("b_sections"), F.col("a_sections")))
    for r in df.collect():
        for places, sections in ((r["removed"], r["a_sections"]), (r["added"], r["b_sections"])):
            before = [0]
            for s in sections:
                before.append(before[-1] + s.count(","))
            found = [before[p["section"]] + p["paragraph"] for p in places]
            if r["n"] == 9:
                assert found == ([20] if places is r["added"] else [])
            else:
                assert found == r["at"]


def test_odd_rows(spark, table):
    rows = [(None, "a\nb"), (None, None), (1, "one\ntwo"), (1, "one\ntwo"), (1, "other"), (2, "\n\n")]
    df = table(rows).withColumns({"root": F.lit(1), "phrases": F.lit("x"), "next_text": F.lit("y"), "_part": F.lit(0)})
    got = merkle.edited_fingerprints(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    last = next(r for r in got if r["doc_id"] == 2)
    assert last["edited_text"] == "\n" + "o" or last["edited_text"][0] == "\n"
    assert all((r["root"] == r["edited_root"]) == (not r["removed"] and not r["added"]) for r in got)
    assert merkle.edited_fingerprints(df.limit(0)).count() == 0
    one = merkle.edited_fingerprints(table([(4, "abcd")])).first()
    assert one["edited_text"] == "abab" and one["near_next"] == 1.0
    assert merkle.fingerprints(df).select("root").distinct().count() == 5

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import similar, simhash


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


def components(rows):
    """Smallest id that links of similarity 0.8 reach, over all pairs."""
    sets, label = [slow_set(t) for _, t in rows], [k for k, _ in rows]
    near = [[j for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    while True:
        after = [min(label[j] for j in own) for own in near]
        if after == label:
            return dict(zip((k for k, _ in rows), label))
        label = after


def corpus(rng):
    """Texts, copies with a few words changed, a hub whose copies are unlike each other, and a common passage."""
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(rng.choices(words, k=12))
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(50)]
    texts += [passage + " " + " ".join(rng.choices(words, k=30)) for _ in range(40)]
    for k in range(90):
        text = rng.choice(texts[:50]).split(" ")
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(len(text))] = "new"
        texts.append(rng.choice([" ", "\n"]).join(text))
    hub = rng.choices(words, k=54)
    texts += [" ".join(hub)] + [" ".join([*hub[:k], f"x{k}", *hub[k + 1:]]) for k in range(5, 48)]
    texts += [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b c d e", "a b c d e f"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("neighbours", [1, 8])
def test_all_pairs_at_the_similarity_are_linked(spark, table, neighbours):
    rows = corpus(random.Random(3))
    found = similar.near_duplicates(table(rows), neighbours=neighbours).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == components(rows) and len(found) == len(rows)


def test_stage_drops_near_copies_that_fingerprints_miss(spark, table):
    rows = corpus(random.Random(8))
    wanted = {k for k, c in components(rows).items() if k == c}
    left = corpus_pipeline.drop_near_copies(spark, table(rows), "")
    assert {r["doc_id"] for r in left.collect()} == wanted


def test_odd_rows(spark, table):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (5, "quite another text here"), (None, None), (3, "a  b\tC")]
    left = similar.drop_near_duplicates(table(rows).withColumn("_node", F.lit("x")))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == [
        ("3", "a  b\tC"), ("5", "quite another text here"), ("None", "None")]
    assert similar.near_duplicates(table([(1, "x")]).limit(0)).count() == 0


def test_sets_that_share_a_passage_are_hardly_compared(spark, table, monkeypatch):
    """A passage in every text: its shingles are in all sets, and still few pairs of unlike sets are looked at."""
    rng, asked = random.Random(4), []
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(300, 400))) + " " + passage) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " more") for k in range(40)]
    whole = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda d, s, pairs, *a: (asked.append(pairs.count()), whole(d, s, pairs, *a))[1])
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(table(rows)).collect()}
    assert all(found[k] == (k - 300 if k >= 300 else k) for k in found) and len(found) == 340
    assert 40 <= sum(asked) < 80


def test_a_large_group_costs_few_comparisons_and_parts(spark, table, monkeypatch):
    """Near copies of one text in one component, its least node's set sent in several parts."""
    rng, asked = random.Random(5), []
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        at = rng.randrange(200)
        rows.append((k, " ".join([*base[:at], f"x{k}", *base[at + 1:]])))
    rows += [(1000, "y " * 100_000), (1001, "z " + "y " * 100_001)]
    monkeypatch.setattr(similar, "PARTNERS", 7)
    whole = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda d, s, pairs, *a: (asked.append(pairs.count()), whole(d, s, pairs, *a))[1])
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(table(rows)).collect()}
    assert {found[k] for k in range(300)} == {0} and (found[1000], found[1001]) == (1000, 1001)
    assert asked[0] < 8 * 300


def test_pairs_meet_as_often_as_they_should():
    """Two sets of similarity 0.8 agree in about 0.8 ** 5 of the bands."""
    shared, agree = [f"s{k}" for k in range(800)], []
    for k in range(30):
        left = {*(f"{k}{s}" for s in shared), *(f"{k}l{j}" for j in range(100))}
        right = {*(f"{k}{s}" for s in shared), *(f"{k}r{j}" for j in range(100))}
        x, y = (similar.band_keys(np.sort(np.array([hash_of(s) for s in t], np.int64))) for t in (left, right))
        agree.append((x == y).mean())
    assert 0.28 < np.mean(agree) < 0.38 and min(agree) > 0


def hash_of(s):
    import xxhash
    return xxhash.xxh64_intdigest(s, 42) - 2 ** 63


def test_pairs_within_the_radius_are_candidates_without_any_band(spark, table, monkeypatch):
    """Fingerprints and their masks find near copies of long texts by themselves; unlike texts stay apart."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(10 ** 6)}" for _ in range(900)] for _ in range(12)]
    rows = [(k, " ".join(t)) for k, t in enumerate(base)]
    rows += [(100 + k, " ".join([*t[:400], "new", *t[401:]])) for k, t in enumerate(base)]
    near = {k for k, t in enumerate(base) if (
        simhash.fingerprint(rows[k][1]) ^ simhash.fingerprint(rows[12 + k][1])).bit_count() <= 3}
    monkeypatch.setattr(similar, "band_keys", lambda own: own[:0])
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(table(rows)).collect()}
    assert len(near) >= 6 and {k for k in range(12) if found[100 + k] == k} >= near
    assert all(found[k] == k for k in range(12)) and all(found[100 + k] in (k, 100 + k) for k in range(12))


def test_a_group_of_unlike_copies_asks_for_few_comparisons(spark, table, monkeypatch):
    """Copies that are mostly less than similar meet everywhere; what is asked for does not grow with their square."""
    rng, asked = random.Random(6), []
    base, rows = [f"w{k}" for k in range(150)], []
    for k in range(240):
        text = list(base) if k % 4 or not rows else rng.choice(rows)[1].split(" ")
        for j in range(rng.randint(2, 9) if k % 4 else 1):
            text[rng.randrange(150)] = f"x{k}_{j}"
        rows.append((k, " ".join(text)))
    whole = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda d, s, pairs, *a: (asked.append(pairs.count()), whole(d, s, pairs, *a))[1])
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(table(rows), neighbours=50).collect()}
    assert found == components(rows) and len(set(found.values())) > 20
    assert sum(asked) < 12 * len(rows)


@pytest.mark.parametrize("left", [0, 30])
@pytest.mark.parametrize("rare", [1, 4, 64])
def test_linked_sets_equal_all_pairs(monkeypatch, left, rare):
    monkeypatch.setattr(similar, "_RARE", rare)
    monkeypatch.setattr(similar, "_WIDE", 7)
    rng = np.random.default_rng(rare)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 12))) for _ in range(70)]
    roots = rng.integers(0, 60, 70)
    pairs = [(i, j) for i in range(70) for j in range(i + 1, 70) if not left or i < left <= j]
    wanted = {(i, j) for i, j in pairs if roots[i] != roots[j] and len(np.intersect1d(sets[i], sets[j])) / len(
        np.union1d(sets[i], sets[j])) >= 0.6}
    assert set(zip(*(x.tolist() for x in similar._linked(sets, roots, left, 0.6)))) == wanted and wanted

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtide.llm import components, simhash
from logtide.llm.queries import QUERIES


def slow_print(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, radius=3):
    """Smallest reachable id for every document, by brute force."""
    label = list(ids)
    x = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    while True:
        after = [min((label[j] for j in np.flatnonzero(near[i])), default=label[i]) for i in range(len(ids))]
        if after == label:
            return label
        label = after


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("fixed", [0, 0xFFFFFFFF00000000, 0x5555555555555555, (1 << 64) - 1 - 0x3FF])
def test_masks_cover_every_pair_within_the_radius(radius, fixed):
    rng, made = random.Random(radius), simhash.masks(radius, fixed)
    free = [b for b in range(64) if not fixed >> b & 1]
    assert all(m & fixed == fixed for m in made)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(free, radius))
        assert any(not diff & m for m in made)


@given(st.text(alphabet="aAbÉß \t\n\x0b\x85 ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_equals_its_definition(text):
    assert simhash.fingerprint(text) == slow_print(text)


def test_spark_xxhash_is_the_same_hash(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("the quick fox")).alias("h")).first()["h"]
    assert value % 2**64 == xxhash.xxh64_intdigest("the quick fox", 42)


@pytest.mark.parametrize("bucket", [256, 2048])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    """A dense cluster overfills buckets of 256, so the second and third family of masks are used."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(1500)}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "_print long").repartition(4)
    links = simhash.links_within(df, 3, bucket)
    for a, b in links.collect():
        assert ((a ^ b) % 2**64).bit_count() <= 64
    roots = {r["node"]: r["root"] for r in components.component_roots(links).collect()}
    got = [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    wanted = groups([simhash._signed(p) for p in prints], prints)
    assert got == wanted


@pytest.mark.parametrize("one_task", [0, 1_000])
def test_components_of_long_paths_and_hubs(spark, one_task):
    path = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    edges = spark.createDataFrame(path, "a long, b long")
    roots = {r["node"]: r["root"] for r in components.component_roots(edges, one_task).collect()}
    assert roots == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)} | {300: 299}
    assert components.component_roots(edges.limit(0), one_task).count() == 0


def test_query_equals_brute_force(spark, saved):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(60, 140):
        text = rng.choice(base).split(" ")
        text[rng.randrange(len(text))] = "new"
        rows.append((k, rng.choice([" ", "\n"]).join(text)))
    rows += [(140, None), (141, ""), (142, " \n"), (143, "one"), (144, "ONE"), (145, "one two"), (146, base[3]),
             (147, " ".join(rng.choices(words, k=150_000)))]
    got = {r["doc_id"]: r for r in QUERIES["op4_simhash_near_dedup"](spark, saved(rows)).collect()}
    prints = [slow_print(t) for _, t in rows]
    assert [got[k]["fingerprint"] for k, _ in rows] == [f"{p:016x}" for p in prints]
    assert [got[k]["component_id"] for k, _ in rows] == groups([k for k, _ in rows], prints)


def test_odd_rows(spark, table):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (5, "quite another text here"), (None, None), (3, "a  b\tC")]
    found = simhash.near_duplicates(table(rows).withColumn("component_id", F.lit("x"))).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == sorted(
        [("None", "3"), ("5", "3"), ("5", "3"), ("5", "5"), ("None", "None"), ("3", "3")])
    left = simhash.drop_near_duplicates(table(rows).withColumn("root", F.lit("x")))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "root"]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == [
        ("3", "a  b\tC"), ("5", "quite another text here"), ("None", "None")]
    assert simhash.drop_near_duplicates(table([(1, "x"), (1, "x"), (1, "x")])).count() == 1
    assert simhash.near_duplicates(table([(1, "x")]).limit(0)).count() == 0

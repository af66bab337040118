import hashlib
import random
import zlib

from pyspark.sql import functions as F

from logtide.llm import runs
from logtide.llm.queries import QUERIES


def slow_runs(words, least=12):
    """Runs by comparing the words with themselves at every distance."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i:i + length]
            if j > i and length >= max(least, 2 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5, 60]), rng.randint(0, 90)
    words = [b"w%d" % rng.randrange(kinds) for _ in range(n)]
    if n > 5 and rng.random() < 0.6:
        start = rng.randrange(n)
        period = 1 + (n - start) // rng.randint(2, 8)
        words = [words[i] if i < start else words[start + (i - start) % period] for i in range(n)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for least in (12, 12, 4, 5, 2):
        for _ in range(60):
            texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
            assert runs.find_runs(texts, least) == [slow_runs(t, least) for t in texts]


def test_long_texts_and_blocks_of_positions():
    assert runs.find_runs([[b"a"] * 50_000, [], [b"b"]]) == [[(0, 50_000, 1)], [], []]
    rng = random.Random(5)
    part = [b"w%d" % rng.randrange(900) for _ in range(4_000)]
    assert runs.find_runs([part * 9 + [b"end"]]) == [[(0, 36_000, 4_000)]]
    assert runs.find_runs([part]) == [[]]
    held = runs.Positions(50_000)
    order = list(range(50_000))
    rng.shuffle(order)
    for p in order[:6_000]:
        ahead, behind = held.add(p)
        assert ahead < p < behind
    assert list(held) == sorted([*order[:6_000], 50_000])


def test_query_equals_brute_force(spark, saved):
    rng, rows = random.Random(6), []
    for k in range(260):
        words = [w.decode() for w in random_words(rng)]
        rows.append((k * 7919, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(5_000_001, None), (5_000_002, ""), (5_000_003, " \n "), (5_000_004, "again " * 40_000), (None, "x y " * 20),
             rows[3], rows[3]]
    found = QUERIES["op11_periodic_runs"](spark, saved(rows)).collect()
    assert len(found) == len(rows)
    wanted, edited = [], 0
    for doc_id, text in rows:
        words = (text or "").split()
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, edited = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], edited + 1
        own = slow_runs(words) if n < 1000 else [(0, n, 1)]
        out = {i for s, length, q in own for i in range(s + q, s + length)}
        best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
        wanted.append((doc_id, len(own), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
                       hashlib.sha256("".join("%d,%d,%d\n" % r for r in own).encode()).hexdigest(),
                       hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in out).encode()).hexdigest()))
    assert edited > 10 and sum(w[1] for w in wanted) > 50
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_operator_on_odd_tables(spark, table):
    docs = table([(1, "a b " * 8 + "c"), (1, "a b " * 8 + "c"), (None, None)]).withColumn("runs", F.lit("x"))
    found = sorted(runs.add_runs(docs).collect(), key=str)
    assert [r["collapsed"] for r in found] == ["a b c", "a b c", ""]
    assert found[0]["runs"][0].asDict() == {"start": 0, "length": 16, "period": 2} == found[0]["longest_run"].asDict()
    assert (found[2]["n_words"], found[2]["runs"], found[2]["longest_run"]) == (0, [], None)
    assert runs.add_runs(docs.limit(0)).count() == 0

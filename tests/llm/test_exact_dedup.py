import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logtide.llm import exact_dedup
from logtide.llm.queries import QUERIES


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_query_equals_brute_force(spark, saved):
    rows = [(k, f"text {k % 7}" if k % 3 else f"TEXT {k % 7}") for k in range(100)]
    rows += [(200, None), (201, ""), (202, " "), (203, "Éa"), (204, "éa"), (205, "ÉA"), (206, "ab\x00c"),
             (207, "x" * 300_000), (208, "X" * 300_000)]
    groups = defaultdict(list)
    for k, t in rows:
        groups[fold(t)].append(k)
    got = {r["doc_id"]: r for r in QUERIES["op10_exact_dedup"](spark, saved(rows)).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for k in ids:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) == (max(ids), len(ids), k == max(ids))
            assert got[k]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("digest", [lambda t: F.lit("same"), lambda t: F.length(t).cast("string")])
def test_texts_that_share_a_digest_stay_apart(spark, table, digest):
    rows = [(k, t) for k, t in enumerate(["a", "b", "A", "cc", None, "", "cc", "b"])]
    marked = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(table(rows), digest).collect()}
    assert {k: r["keep_id"] for k, r in marked.items()} == {0: 2, 2: 2, 1: 7, 7: 7, 3: 6, 6: 6, 4: 5, 5: 5}
    assert {k for k, r in marked.items() if r["kept"]} == {2, 7, 6, 5}
    left = exact_dedup.drop_exact_duplicates(table(rows), digest)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 5, 6, 7]


def test_odd_rows(spark, table):
    rows = [(5, "Same", "en"), (5, "same", "de"), (5, "Same", "en"), (4, "SAME"), (None, "n"), (None, "n"), (1, "n"),
            (None, None)]
    df = table([(*r, None, None)[:4] for r in rows]).withColumns(
        {"keep_id": F.lit("x"), "kept": F.lit(3), "_digest": F.lit(0)})
    marked = exact_dedup.exact_duplicates(df).collect()
    assert len(marked) == len(rows) and sum(r["kept"] for r in marked) == 3
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in marked} == {
        (5, 5, 4), (4, 5, 4), (None, 1, 3), (1, 1, 3), (None, None, 1)}
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "5", "None"]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0

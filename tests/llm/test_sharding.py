import random
import zlib

import pytest
from pyspark.sql import functions as F

from logtide.llm import rows, sharding
from logtide.llm.queries import QUERIES


def expected(rows_, shards):
    """Shard and slot of rows with distinct ids, one after the other."""
    ordered = sorted(rows_, key=lambda r: r[0])
    sizes = [len((t or "").encode()) + 16 for _, t in ordered]
    total, before, slots, out = sum(sizes), 0, {}, {}
    for (k, t), size in zip(ordered, sizes):
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out[k] = (size, zlib.crc32((t or "").encode()), shard, slots.setdefault(shard, 0))
        slots[shard] += 1
        before += size
    return out


def test_query_equals_one_pass_over_the_rows(spark, saved):
    rng = random.Random(2)
    data = [(k * 7 - 300, rng.choice([None, "", "é", "word " * rng.randint(1, 300)])) for k in range(500)]
    data += [(10**12, "x" * 200_000), (-(10**12), "long")]
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"])
           for r in QUERIES["op1_sharding"](spark, saved(data)).collect()}
    assert got == expected(data, 40)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_repeated_rows_null_ids_and_clashing_columns(spark, table, parts):
    data = [(None, "a")] * 200 + [(1, "same")] * 300 + [(2, None), (2, ""), (3, "b")]
    df = table(data, parts).withColumns({"shard": F.lit("x"), "size": F.lit(1), "slot": F.lit(2)})
    got = sharding.assign_shards(df, 8).collect()
    assert len(got) == 503
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 20
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_empty_table(spark, table):
    assert sharding.assign_shards(table([(1, "a")]).limit(0)).count() == 0


def test_written_shards_hold_every_row(spark, table, tmp_path):
    data = [(k, f"text {k}") for k in range(50)] + [(7, "text 7")] * 2
    sharding.write_shards(table(data), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted(data)
    assert back.select("shard").distinct().count() == 5


def test_positions_do_not_depend_on_cuts(spark):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("(id * 7919) % 5003 as k", "id % 10 as v")
    for parts in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        placed, n, total = rows.numbered(df, ["k"], "v")
        got = placed.orderBy("k").collect()
        assert [r["_position"] for r in got] == list(range(5000)) and n == 5000
        running = 0
        for r in got:
            assert r["_before"] == running
            running += r["v"]
        assert total == running
    spark.conf.set("spark.sql.shuffle.partitions", "4")

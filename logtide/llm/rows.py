"""Row order, row numbers and row identity of tables of any size; helpers of the operators beside it.

Nothing here depends on how Spark happens to cut a table into partitions. A total order is cut at split
points that are taken from a sample; a row's part is a function of the row alone, so that two passes over
the table agree even when an executor was lost in between. The sample decides where cuts lie, never what
comes out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.plans.materialize import materialize

#: Sampled rows per part. The driver holds at most about this many times the number of parts.
SAMPLE_PER_PART = 20
#: Most parts, and thus the most split points a plan carries.
MOST_PARTS = 20_000


def words_of(text: Column) -> Column:
    """Array of the words of a text: runs of anything but ASCII white space. Null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(pieces, lambda w: w != "")


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """64-bit hash of the named columns, or of all but map columns; nulls count as values of their own."""
    names = columns or [c for c, t in df.dtypes if not t.startswith("map") and t not in ("variant", "void")]
    return F.xxhash64(*[x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def parts_for(df: DataFrame) -> int:
    return min(MOST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, order: Sequence[str], parts: int, seed: int = 7) -> list:
    """Up to ``parts - 1`` rows of ``order`` that cut the table into about equal parts."""
    total = df.count()
    if total == 0 or parts < 2:
        return []
    share = min(1.0, SAMPLE_PER_PART * parts / total)
    drawn = df.select(*order) if share == 1.0 else df.select(*order).sample(share, seed=seed)
    sampled = drawn.orderBy(*order).collect()
    cuts = [sampled[len(sampled) * k // parts] for k in range(1, parts)] if sampled else []
    return [c for k, c in enumerate(cuts) if k == 0 or c != cuts[k - 1]]


def part_of(df: DataFrame, order: Sequence[str], cuts: list) -> Column:
    """Number of cuts that are not above the row: its part, found by halving.

    The columns of ``order`` hold integers, booleans or strings.
    """
    if not cuts:
        return F.lit(0)
    kinds = dict(df.dtypes)
    listed = json.dumps([dict(zip(order, cut)) for cut in cuts])  # one constant; a literal for each would be slow
    points = F.from_json(F.lit(listed), f"array<struct<{', '.join(f'{c}: {kinds[c]}' for c in order)}>>")
    own = F.struct(*[F.col(c).alias(c) for c in order])

    def halve(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(points, mid) <= own
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(cuts) + 1))))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def numbered(df: DataFrame, order: Sequence[str], total: str | None = None) -> tuple[DataFrame, int, int]:
    """Rows with their place in a total order, and the table's row count and sum of ``total``.

    Adds ``_position`` (from 0) and, with ``total``, ``_before`` (sum of the column over all rows in front).
    Per-part totals are summed on the driver - one row per part, at most ``MOST_PARTS`` - and each part adds
    its offset to its own running sums: no row passes through a single task. Nulls come first. Rows that
    agree in all of ``order`` are numbered in any order, so end ``order`` with a column that is unique.
    """
    cuts = split_points(df, order, parts_for(df))
    placed = df.withColumn("_part", part_of(df, order, cuts))
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total) if total else F.lit(0), F.lit(0)).alias("s")]
    per_part = {r["_part"]: (r["n"], r["s"]) for r in placed.groupBy("_part").agg(*sums).collect()}
    offsets, rows, amount = [], 0, 0
    for part in range(len(cuts) + 1):
        offsets.append((part, rows, amount))
        n, s = per_part.get(part, (0, 0))
        rows, amount = rows + n, amount + s
    base = df.sparkSession.createDataFrame(offsets, "_part int, _rows long, _sum long")
    inside = Window.partitionBy("_part").orderBy(*order)
    columns = {"_position": F.row_number().over(inside) - 1 + F.col("_rows")}
    if total:
        ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
        columns["_before"] = F.coalesce(F.sum(total).over(ahead), F.lit(0)) + F.col("_sum")
    placed = placed.join(F.broadcast(base), "_part").withColumns(columns)
    return placed.drop("_part", "_rows", "_sum"), rows, amount


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (``doc_id``, ``row_hash``) is in ``keys``, one row for each key, as ``_doc``.

    ``keys`` holds doc_id, _hash, _copies (rows of ``docs`` with that key) and further columns, which stand beside
    ``_doc``; select ``_doc.*`` for the rows as they were. Only keys with several identical rows need the texts to
    be grouped; none is the usual case.
    """
    further = [c for c in keys.columns if c not in ("doc_id", "_hash", "_copies")]
    right = keys.withColumnRenamed("doc_id", "_key_id").withColumnRenamed("_hash", "_key_hash")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row_hash(docs).alias("_hash"))
    match = F.col("_doc.doc_id").eqNullSafe(F.col("_key_id")) & (F.col("_hash") == F.col("_key_hash"))
    joined = left.join(right, match)
    if keys.filter("_copies > 1").isEmpty():
        return joined.select("_doc", *further)
    again = joined.filter("_copies > 1").dropDuplicates(["_key_id", "_key_hash"])
    return joined.filter("_copies = 1").unionByName(again).select("_doc", *further)


def stored_keys(df: DataFrame) -> DataFrame:
    """``df`` (narrow) with a unique ``_row``, fixed by storing it."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()))

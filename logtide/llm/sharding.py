"""Contiguous shards of equal bytes.

Rows are put in one total order; per-part byte totals give every part its offset, so every row learns the bytes
in front of it in the whole table. The order is cut at equal byte targets: a row goes to the shard in whose
share of the total its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.rows import keep_rows, numbered, row_hash, stored_keys

#: Bytes that a row takes beside its text.
ROW_BYTES = 16


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), row_hash(docs).alias("_hash"))


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (and _hash, which tells rows of one id apart).

    The order is doc_id (null first), then a hash of the row; repeated rows follow each other. Shards are
    0 to ``shards - 1``, their sizes equal to within one row; a row above a whole share leaves shards empty.
    ``slot`` counts the rows of a shard from 0 in order. A null text has no bytes. An empty table gives no rows.
    Only doc_id, text and the row hash are used, so other columns cannot clash.
    """
    rows = stored_keys(_sized(docs))
    placed, _, total = numbered(rows, ["doc_id", "_hash", "_row"], "size")
    middle = "cast(2 * _before + size as decimal(38,0))"  # twice the middle byte; products go beyond 64 bits
    shard = F.expr(f"cast(({middle} * {shards}) div {2 * max(total, 1)} as int)")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    first = placed.groupBy("shard").agg(F.min("_position").alias("_first"))  # at most one row per shard
    placed = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_position") - F.col("_first"))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "_hash")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """The documents as one folder per shard (``shard=0``, …), rows in slot order within a file.

    Columns named shard or slot are replaced. Rows that repeat one another are written as often as they
    occur, in the shard of the first of them.
    """
    docs = docs.drop("shard", "slot")
    keys = assign_shards(docs, shards).groupBy("doc_id", "_hash").agg(
        F.count(F.lit(1)).alias("_copies"), F.count(F.lit(1)).alias("_times"), F.min(F.struct("shard", "slot")).alias("_at"))
    rows = keep_rows(docs, keys).withColumn("_times", F.explode(F.expr("sequence(1, int(_times))")))
    rows = rows.select("_doc.*", "_at.*")
    rows.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)

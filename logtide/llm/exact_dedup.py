"""Exact duplicates by skew-safe combining.

Copies are first combined where they lie (Spark's map-side aggregation), then per (digest, salt), so that
a text holding a third of all rows is spread over ``salts`` groups, and at last the winners of the salts are
combined per digest. Every stage groups by the whole text beside its digest: two texts that share a digest
are never taken for equal. Documents then find their group by digest; only for digests that several texts
share (none, with SHA-256) is the text compared once more.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.rows import keep_rows, row_hash, stored_keys
from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize


def fold_ascii(text: Column) -> Column:
    """Text with A-Z in lower case and nothing else changed; null becomes the empty text."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def combine_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: digest, text, largest doc_id and number of documents."""
    rows = docs.select("doc_id", fold_ascii(F.col("text")).alias("_text")).select(
        "doc_id", "_text", digest(F.col("_text")).alias("_digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt"))
    per_salt = rows.groupBy("_digest", "_salt", "_text").agg(
        F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    return per_salt.repartition("_digest").groupBy("_digest", "_text").agg(
        F.max("_keep").alias("keep_id"), F.sum("_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest doc_id of
    a group stays (null is the smallest); of rows that repeat that doc_id with an equal text one stays.
    An empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    return _marked(docs, digest, salts).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """The documents that stay, all columns unchanged."""
    kept = _marked(docs, digest, salts, row_hash(docs)).filter("kept").select("doc_id", "_hash", "_copies")
    return keep_rows(docs, kept).select("_doc.*")


def _marked(docs: DataFrame, digest, salts: int, identity: Column | None = None) -> DataFrame:
    text = fold_ascii(F.col("text"))
    rows = stored_keys(docs.select(
        "doc_id", text.alias("_text"), (F.lit(0) if identity is None else identity).alias("_hash")).select(
        "doc_id", "_hash", sha256(F.col("_text")).alias("_sha"), digest(F.col("_text")).alias("_digest")))
    combined = combine_copies(docs, digest, salts)
    texts = combined.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    texts = materialize(texts)
    single = texts.filter("_texts = 1").drop("_texts")
    if texts.filter("_texts > 1").isEmpty():
        marked = rows.join(single, "_digest")
    else:  # a digest shared by several texts: those documents are held against the texts themselves
        shared = texts.filter("_texts > 1").select("_digest")
        exact = combined.join(shared, "_digest").select(
            "_digest", sha256(F.col("_text")).alias("_sha"), "_text", "keep_id", "group_size")
        own = docs.select("doc_id", text.alias("_text"), (F.lit(0) if identity is None else identity).alias("_hash"))
        own = own.withColumns({"_digest": digest(F.col("_text")), "_sha": sha256(F.col("_text"))})
        own = stored_keys(own.join(exact.drop("_sha"), ["_digest", "_text"]).drop("_text"))
        columns = ["doc_id", "_hash", "_sha", "_digest", "_row", "keep_id", "group_size"]
        marked = rows.join(single, "_digest").select(*columns).unionByName(
            own.withColumn("_row", -1 - F.col("_row")).select(*columns))
    return _one_of_repeats(marked)


def _one_of_repeats(marked: DataFrame) -> DataFrame:
    """``kept``: the row with the group's keep_id, and only one of rows that repeat it."""
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeats = marked.filter(stays).groupBy("_sha", "_digest").agg(
        F.count(F.lit(1)).alias("_times"), F.min("_row").alias("_first")).filter("_times > 1").drop("_times")
    joined = join_small(marked, repeats, ["_sha", "_digest"])
    first = F.col("_first").isNull() | (F.col("_row") == F.col("_first"))
    return joined.withColumns({"kept": stays & first, "_copies": F.when(F.col("_first").isNull(), 1).otherwise(2)})

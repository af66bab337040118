"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality: a line-level conditional random field, learnt from ``labels``, rejects documents;
2. exact duplicates: of equal texts the document with the largest id stays;
3. near-duplicates: of documents linked by a similarity of 0.8 over shingles of 5 words the one with the smallest id
   stays;
4. mixing: documents are taken as often as the sources' target weights ask for;
5. tokens: every text becomes SentencePiece ids with their byte spans.

All stages but the last return the columns they were given. A null text counts as empty, an empty table stays
empty, repeated rows are duplicates, and further columns travel along unless a stage's own columns replace them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import exact_dedup, line_quality, mixing, pieces, similar
from logtide.llm.queries import documents, labels, piece_model
from logtide.plans.materialize import materialize

#: The quality field and the pieces are no SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field does not reject; it is learnt from the labelled documents of the table."""
    field = line_quality.fit(docs, line_quality.learning_labels(labels(spark, sf_dir)))
    return line_quality.keep_good(docs, field)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return similar.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and byte spans of every document, one row for each time it was taken."""
    found = pieces.encode_documents(docs, piece_model())
    return found.withColumn("n_tokens", F.size("ids").cast("long")).select(
        "doc_id", "source", "lang", "n_tokens", "ids", "begins", "ends")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is stored in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs

"""One query for each operator, over the whole ``documents`` table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import (
    exact_dedup, hard_negatives, language, line_quality, merkle, mixing, pieces, pseudonyms, runs, secret_scan, sharding, simhash,
    toxicity,
)
from logtide.llm.rows import words_of
from logtide.llm.samples import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query()
def op4_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.to_hex("_print").alias("fingerprint"), "component_id")


@query()
def op1_sharding(spark, sf_dir):
    found = sharding.assign_shards(documents(spark, sf_dir), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query()
def op6_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query(merkle.SQL)
def op8_document_fingerprints(spark, sf_dir):
    found = merkle.edited_fingerprints(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", exact_dedup.sha256(F.col("edited_text")).alias("edited_sha256"),
                        F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
                        F.round("near_edited", 9).alias("near_edited"), F.round("near_next", 9).alias("near_next"),
                        merkle.written_places("removed").alias("removed"), merkle.written_places("added").alias("added"))


#: A secret in real use; the registered query needs a fixed one to be repeatable.
PSEUDONYM_KEY = "registered query"


@query()
def op7_pii(spark, sf_dir):
    found = pseudonyms.pseudonymise(documents(spark, sf_dir), PSEUDONYM_KEY)
    return found.withColumns(pseudonyms.count_kinds()).select(
        "doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *[f"n_{k}" for k in pseudonyms.KINDS])


def piece_model() -> bytes:
    """The public 32,000-piece model."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query()
def op2_sentencepiece(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    found = pieces.encode_documents(rows, piece_model(), packed=True, decode=True)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        exact_dedup.sha256(F.col("decoded")).alias("decoded_sha256"),
        F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))


@query()
def op5_language_id(spark, sf_dir):
    return language.learn_and_predict(documents(spark, sf_dir))


@query()
def op3_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secret_scan.find_secrets(docs, secret_scan.fit(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *[secret_scan.number("secrets", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        exact_dedup.sha256(secret_scan.written(base)).alias("base_sha256"),
        secret_scan.written(F.col("secrets")).alias("spans"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query()
def op9_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    field = line_quality.fit(docs, line_quality.learning_labels(labels(spark, sf_dir)))
    scored = line_quality.score_documents(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def repeated_tail(docs: DataFrame) -> DataFrame:
    """``docs`` where a tenth of the texts, by crc32 of the id, repeats some words from a place on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = F.col("_words"), F.floor(h / 10)
    n = F.size(words).cast("long")
    start = g % n
    period = 1 + F.floor((n - start) / (3 + g % 8))
    source = lambda i: F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int")
    edited = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i))))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    docs = docs.withColumn("_words", F.when(chosen, words_of(F.col("text"))))
    return docs.withColumn("text", F.when(chosen & (n > 0), edited).otherwise(F.col("text"))).drop("_words")


@query()
def op11_periodic_runs(spark, sf_dir):
    found = runs.add_runs(repeated_tail(documents(spark, sf_dir).select("doc_id", "text")))
    best = F.col("longest_run")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        "runs_sha256", exact_dedup.sha256(F.col("collapsed")).alias("collapsed_sha256"))


@query()
def op13_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learning_labels(labels(spark, sf_dir)))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("""WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike,
      CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  n AS (
    SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS place
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike
      AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
  SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
  FROM n WHERE place <= 3""")
def op12_hard_negatives(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepare(table, label, hard_negatives.quantised("embedding", 256),
                                  hard_negatives.finite("embedding"), F.col("vec_id") % 50 == 0)
    return hard_negatives.hard_negatives(rows)

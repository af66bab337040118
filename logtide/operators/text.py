"""Text vectors of log messages: the most frequent terms, counts and TF-IDF weights."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a word has two or more word characters.
WORD_PATTERN = r"\w\w+"


def message_terms(df: DataFrame, column: str = "message", max_n: int = 2) -> DataFrame:
    """Add ``terms``: the lower-case words of the text and its n-grams up to ``max_n`` words."""
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=WORD_PATTERN, gaps=False, toLowercase=True)
    tokens = words.transform(df.withColumn("_text", F.coalesce(F.col(column), F.lit(""))))
    parts = ["_words"]
    for n in range(2, max_n + 1):
        parts.append(f"_grams_{n}")
        tokens = NGram(n=n, inputCol="_words", outputCol=parts[-1]).transform(tokens)
    return tokens.withColumn("terms", F.concat(*parts)).drop("_text", *parts)


def term_counts(df: DataFrame, max_features: int = 100) -> DataFrame:
    """The most frequent terms with their total and document counts; ties go by term."""
    each = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    once = F.transform(
        F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    return (
        message_terms(df).select(F.explode(F.concat(each, once)).alias("t"))
        .groupBy(F.col("t.term").alias("term"))
        .agg(F.sum("t.n").alias("term_count"), F.sum("t.d").alias("document_count"))
        .orderBy(F.desc("term_count"), "term").limit(max_features)
    )


def text_vectors(df: DataFrame, max_features: int = 100) -> DataFrame:
    """Add the sparse vectors ``term_vector`` (counts) and ``tfidf`` over the most frequent terms."""
    vocabulary = [r["term"] for r in term_counts(df, max_features).collect()]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="term_vector")
    counted = counter.transform(message_terms(df))
    return IDF(inputCol="term_vector", outputCol="tfidf").fit(counted).transform(counted).drop("terms")


def term_weights(df: DataFrame, key: str = "log_id", max_features: int = 100) -> DataFrame:
    """``key``, term, weight: the TF-IDF weights as rows, one for each frequent term of a text."""
    vocabulary = [r["term"] for r in term_counts(df, max_features).collect()]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="term_vector")
    counted = counter.transform(message_terms(df))
    weighted = IDF(inputCol="term_vector", outputCol="tfidf").fit(counted).transform(counted)
    parts = F.unwrap_udt("tfidf")  # counts above 0 only; a term in every text has its place, with weight 0
    rows = weighted.select(key, F.explode(F.arrays_zip(parts["indices"].alias("at"), parts["values"].alias("weight"))).alias("t"))
    terms = F.array(*[F.lit(t) for t in vocabulary])
    return rows.select(key, F.get(terms, F.col("t.at")).alias("term"), F.col("t.weight").alias("weight"))

"""Token documents: counts, tf-idf, n-grams, and word-vector features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.aggregates import ordered_list, stats
from riskloom.functions.scalar import text_token


def words(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def token_lists(df: DataFrame, key: str, value: str, order: Sequence[str], name: str = "tokens") -> DataFrame:
    """Per key its values in order, as text (null is a token)."""
    return df.groupBy(key).agg(ordered_list(text_token(value), *map(F.col, order)).alias(name))


def joined_documents(df: DataFrame, key: str, value: str, order: Sequence[str], name: str = "document") -> DataFrame:
    lists = token_lists(df, key, value, order, "_tokens")
    return lists.select(key, F.array_join("_tokens", " ").alias(name))


def with_pairs(tokens: Column) -> Column:
    """The tokens and the pairs of neighbours, joined by a space."""
    following = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), following, lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, pairs)


def term_counts(docs: DataFrame, key: str, tokens: Column | str) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def kept_terms(counts: DataFrame, documents: int, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """(term, df) of the terms in ``min_df`` documents or more and in at most that share of them."""
    return document_frequency(counts).where((F.col("df") >= min_df) & (F.col("df") <= max_share * documents))


def tf_idf(counts: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each document
    scaled to length one. ``documents``: one row per document, for n."""
    n = documents.agg(F.count("*").alias("n"))
    terms = document_frequency(counts).join(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = counts.join(terms, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return weighted.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))


def _vectors(sentences: DataFrame, column: str, size: int, window: int, min_count: int, seed: int, iterations: int) -> DataFrame:
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, maxIter=iterations, inputCol=column, outputCol="_out").fit(sentences)
    return model.getVectors().select(F.col("word").alias("_token"), vector_to_array("vector").alias("_vector"))


def sequence_vectors(df: DataFrame, key: str, value: str, order: Sequence[str], size: int = 10, window: int = 10, min_count: int = 2, seed: int = 2018) -> DataFrame:
    """Word vectors of a value within its key's sequence; per key the mean and
    skew of every dimension over the key's rows."""
    vectors = _vectors(token_lists(df, key, value, order), "tokens", size, window, min_count, seed, 1)
    rows = df.select(key, text_token(value).alias("_token")).join(vectors, "_token", "left")
    dims = rows.select(key, *(F.col("_vector")[i].alias(f"{value}_{i}") for i in range(size)))
    return dims.groupBy(key).agg(*(a for i in range(size) for a in stats(f"{value}_{i}", ("mean", "skew"))))


def row_vectors(df: DataFrame, key: str, columns: Sequence[str], size: int = 10, window: int = 2, seed: int = 2018, iterations: int = 10) -> DataFrame:
    """Word vectors with a row's values as a sentence; per key and column the
    min, max, mean and std of every dimension over its distinct values."""
    sentences = df.select(F.array(*(F.concat(F.lit(f"{c}="), text_token(c)) for c in columns)).alias("tokens"))
    vectors = _vectors(sentences, "tokens", size, window, 1, seed, iterations)
    tokens = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.concat(F.lit(f"{c}="), text_token(c)).alias("_token")) for c in columns))).alias("x"))
    rows = tokens.select(key, "x.c", "x._token").distinct().join(vectors, "_token")
    dims = rows.select(key, "c", *(F.col("_vector")[i].alias(f"v{i}") for i in range(size)))
    return dims.groupBy(key, "c").agg(*(a for i in range(size) for a in stats(f"v{i}", ("min", "max", "mean", "std"))))

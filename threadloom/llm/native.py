"""Word shingles as DataFrame expressions, for operators that stay free of Python code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_shingles(df: DataFrame, text: Column, size: int, out: str, separator: str = r"\s+") -> DataFrame:
    """Add ``out``: the xxhash64 of every ``size``-word shingle of ``text``, lower-cased.

    A text with fewer words is one shingle; a text without words, or null, has none. Words are
    hashed once, into a projection of their own, and shingles hash runs of word hashes.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), separator), lambda w: w != "")
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_words")
    places = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
    runs = F.transform(places, lambda i: F.xxhash64(F.slice(F.col("_words"), i, size)))
    return hashed.withColumn(out, F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))).drop("_words")

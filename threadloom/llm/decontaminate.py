"""Benchmark decontamination by size-partitioned MinHash containment search.

Documents are partitioned by the bit length of their number of distinct shingles. Each document
gets a one-permutation MinHash signature: the smallest hash of each of 2^(size class + level) bins.
Bins follow hash prefixes, so a signature of fewer bins is part of one with more. Items are
partitioned by size as well: an item of n shingles that reaches the threshold has at least
``percent`` of n in the document, and its level is the lowest at which all of these are hidden
behind smaller hashes with a chance of ``miss`` at most. Short items need many bins, longer ones
few; a document keeps one signature for the level of the shortest item. Items probe with all
their shingles, and each pair that meets is verified by exact containment of shingle sets.
DataFrame expressions only.

Defined cases: case and punctuation don't count; null or empty texts and items match nothing; an
item of fewer than ``words`` words is searched as one shingle of its own length; rows that repeat
a doc_id count as one document, which leaks where one of its rows does; repeated item rows count
once; documents or items without id are ignored; extra columns are ignored; an empty benchmark
finds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.native import with_shingles
from threadloom.llm.work import save

WORDS = 5
PERCENT = 80
#: Chance that an item which just reaches the threshold is not met; whole copies are met more surely.
MISS = 0.01
#: Levels of bins: 2^-6 to 2^6 times the size class.
LEVELS = tuple(range(-6, 7))
#: Probe keys of the benchmark are broadcast up to this many (16 bytes each); else they are shuffled.
BROADCAST_KEYS = 2_000_000
_NOT_WORD = r"[^\p{L}\p{N}]+"


def _grams(df: DataFrame, words: int) -> DataFrame:
    df = with_shingles(df, F.col("text"), words, "_g", _NOT_WORD)
    return df.withColumn("grams", F.array_distinct("_g")).drop("_g", "text")


def kept_share(level: int) -> float:
    """The least share of a document's shingles that 2^(size class + level) bins keep."""
    bins = 2.0**level
    return bins * -math.expm1(-1 / bins)


def least_shingles(level: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest shingles of an item that is met at ``level`` with a chance of 1 - ``miss``."""
    common = max(1, math.ceil(math.log(miss) / math.log1p(-kept_share(level)) - 1e-9))
    return (common - 1) * 100 // percent + 1


def level_of(shingles: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The lowest level that does for an item of so many shingles.

    The highest level where none does: then nearly all shingles are kept.
    """
    return next((v for v in LEVELS if shingles >= least_shingles(v, percent, miss)), LEVELS[-1])


def signature(docs: DataFrame, levels: list[int]) -> DataFrame:
    """``doc_id, signature``: the hashes that are the smallest of their bin at the highest of ``levels``.

    Each comes with the lowest of ``levels`` at which it is so.
    """
    sized = docs.withColumn("_s", F.sort_array("grams")).withColumn("_class", F.length(F.bin(F.greatest(F.size("grams") - 1, F.lit(0)))))

    def first_in_bin(h: Column, i: Column, level: int) -> Column:
        shift = F.least(F.greatest(64 - F.col("_class") - level, F.lit(0)), F.lit(63))
        cut = lambda x: F.call_function("shiftright", x, shift)
        # no bits at all are one bin, whatever the sign
        return (i == 0) | ((F.col("_class") + level > 0) & (cut(h) != cut(F.get("_s", i - 1))))

    kept = F.filter("_s", lambda h, i: first_in_bin(h, i, max(levels)))
    sized = sized.withColumn("_s", kept)
    # what is between two kept hashes lies in the bin of the first, so neighbours still tell bins apart

    def lowest(h: Column, i: Column) -> Column:
        out = F.lit(max(levels))
        for level in sorted(levels, reverse=True)[1:]:
            out = F.when(first_in_bin(h, i, level), level).otherwise(out)
        return F.struct(h.alias("h"), out.alias("level"))

    return sized.select("doc_id", F.transform("_s", lowest).alias("signature"))


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment`` of every leaked item."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    count = F.size(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), _NOT_WORD), lambda w: w != ""))
    items = items.withColumn("_n", F.least(count, F.lit(words))).filter("_n > 0").distinct()
    lengths = sorted(r["_n"] for r in items.select("_n").distinct().collect())
    found = None
    for n in lengths:
        part = _leaks(docs, items.filter(F.col("_n") == n).drop("_n"), n, percent, miss)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles int, n_found int, containment double")
    return found


def _leaks(docs: DataFrame, items: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    items = save(_grams(items, words).withColumn("n", F.size("grams")))
    sizes = items.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    levels = list(range(level_of(sizes["most"], percent, miss), level_of(sizes["least"], percent, miss) + 1))
    own = F.lit(levels[-1])
    for level in reversed(levels[:-1]):
        own = F.when(F.col("n") >= least_shingles(level, percent, miss), level).otherwise(own)
    probes = save(items.select("item_id", F.explode("grams").alias("h"), own.alias("item_level")))
    near = F.broadcast(probes) if probes.count() <= BROADCAST_KEYS else probes
    # the outer form infers no filter on the array, which would compute the signature twice
    bins = signature(_grams(docs, words), levels).select("doc_id", F.explode_outer("signature").alias("x")).select("doc_id", "x.h", "x.level")
    pairs = save(bins.join(near, "h").filter("level <= item_level").select("doc_id", "item_id").distinct())
    some = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    both = _grams(some, words).join(pairs, "doc_id").join(items.withColumnRenamed("grams", "wanted"), "item_id")
    both = both.withColumn("n_found", F.size(F.array_intersect("grams", "wanted")))
    sure = both.filter(F.col("n_found") * 100 >= F.col("n") * percent)
    sure = sure.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return sure.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document holds no test item; rows without doc_id stay."""
    bad = save(leaks(docs, benchmark, words, percent).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)

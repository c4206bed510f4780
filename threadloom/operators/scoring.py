"""Scorers and embedders as parts that callers bring, with a cache of scores.

A scorer is a function of a query and a list of texts that returns a score for each text, as
``(index, score)`` in any order; an embedder turns a role (``query`` or ``document``) and a list of
texts into as many vectors. Both run in batches inside tasks; a batch that comes back incomplete
fails as a whole, and Spark runs its task again. Scores are stored by the fingerprint of the query's
context, the query's chunk, the message and the message's chunk, and no stored pair is scored again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from threadloom.sources.scratch import save

#: What a service takes at once.
BATCH = 32
KEYS = ["fingerprint", "chunk_no", "message_id", "chunk_index"]

Scorer = Callable[[str, list[str]], Iterable[tuple[int, float]]]
Embedder = Callable[[str, list[str]], list[list[float]]]


def aligned(hits: Iterable[tuple[int, float]], n: int) -> list[float]:
    """Scores in the order of the texts; an index that is missing, repeated or out of range is an error."""
    out: list[float | None] = [None] * n
    for index, score in hits:
        if not 0 <= index < n or out[index] is not None:
            raise ValueError(f"the scorer returned the index {index} twice or beyond its {n} texts")
        out[index] = float(score)
    if None in out:
        raise ValueError(f"the scorer returned {n - out.count(None)} scores for {n} texts")
    return out


def scores(pairs: DataFrame, scorer: Scorer, model: str, batch: int = BATCH) -> DataFrame:
    """``pairs (KEYS, query_text, text)`` with ``score`` and ``scorer_model``, without the texts.

    Pairs of one query chunk are dealt to tasks together, in parts, so that batches are full. An
    empty or null query scores 0 with all texts and asks nobody; a null text is empty.
    """
    parts = F.pmod(F.xxhash64("message_id", "chunk_index"), F.lit(8))
    dealt = pairs.select(*KEYS, F.coalesce("query_text", F.lit("")).alias("query_text"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartition("fingerprint", "chunk_no", parts).sortWithinPartitions("fingerprint", "chunk_no")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for query, rows in frame.groupby("query_text", sort=False):
                for at in range(0, len(rows), batch):
                    part = rows.iloc[at : at + batch]
                    own = aligned(scorer(query, part["text"].tolist()), len(part)) if query else [0.0] * len(part)
                    yield part[KEYS].assign(score=own, scorer_model=model)

    kinds = dict(pairs.dtypes)
    return dealt.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", score double, scorer_model string")


def cached_scores(pairs: DataFrame, scorer: Scorer, model: str, cache: str, batch: int = BATCH) -> tuple[DataFrame, int]:
    """Scores of all pairs and how many of them were new; new ones go into the folder ``cache`` once.

    The cache is stored by model, so that scores of models never mix. Pairs that repeat are scored
    once.
    """
    spark, kinds = pairs.sparkSession, dict(pairs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", score double"
    path = f"{cache}/scorer_model={model}"
    known = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    asked = pairs.dropDuplicates(KEYS)
    fresh = save(scores(asked.join(known, KEYS, "left_anti"), scorer, model, batch).drop("scorer_model"))
    n_new = fresh.count()
    if n_new:
        fresh.write.mode("append").parquet(path)
    found = fresh.unionByName(known.join(asked.select(*KEYS), KEYS, "left_semi"))
    return pairs.select(*KEYS).join(found, KEYS).withColumn("scorer_model", F.lit(model)), n_new


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def embedded(texts: DataFrame, embedder: Embedder, role: str, model: str, column: str = "text", batch: int = BATCH) -> DataFrame:
    """``texts`` with ``vector`` and ``model_id``; too few vectors, or vectors of several widths, fail the batch."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in series:
            out: list = []
            for at in range(0, len(own), batch):
                asked = [t or "" for t in own.iloc[at : at + batch]]
                got = embedder(role, asked)
                if len(got) != len(asked) or len({len(v) for v in got}) > 1:
                    raise ValueError(f"the embedder returned {len(got)} vectors of {len({len(v) for v in got})} widths for {len(asked)} texts")
                out += got
            yield pd.Series(out, dtype=object)

    return texts.withColumn("vector", run(F.col(column))).withColumn("model_id", F.lit(model))


def shared_words(query: str, texts: list[str]) -> list[tuple[int, float]]:
    """A lexical scorer: the share of the query's words (runs of a-z, lower-cased) that a text has."""
    words = _words(query)
    return [(k, len(words & _words(t)) / len(words) if words else 0.0) for k, t in enumerate(texts)]


def _words(text: str) -> set[str]:
    return set("".join(c if "a" <= c <= "z" else " " for c in text.lower()).split())

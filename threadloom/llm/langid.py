"""Language identification by error-correcting output codes.

Every language has a codeword; for every bit of it a binary classifier tells the languages whose
bit is set from the others. The classifiers are log ratios of the smoothed frequencies of hashed
letter n-grams (one to three letters), counted over all training documents by partition and added
up, so that training is one pass and what the driver gets is languages times buckets. A text's
bits are decoded by loss: the language whose codeword has the least sum of logistic losses wins,
the losses' softmax is its score, and a text whose best languages are too close is ambiguous.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text
where nothing can be learned from; with a single language every text with letters is that one; ties
go to the first language in alphabetic order; rows that repeat a doc_id are judged each by its
text; rows without doc_id are neither held out nor learned from; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrays import slices

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
#: Evidence grows with a text's letters up to this many.
ENOUGH_LETTERS = 200
AMBIGUOUS = 0.5
UNKNOWN = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams around every letter, one row per letter, and each text's rows."""
    lower = [t.lower() for t in texts]
    ends = np.cumsum([0, *(len(t) + 1 for t in lower)])
    points = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    clean = np.where(letter, points, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    rows = np.searchsorted(at, ends)
    if not len(at):
        return np.zeros((0, 3), np.int64), rows
    mid, after = clean[at], clean[np.minimum(at + 1, len(clean) - 1)]
    before = np.where(at > 0, clean[np.maximum(at - 1, 0)], np.uint64(32))
    one = mid * _MIX[0]
    two = one + after * _MIX[1]
    three = two + (before + np.uint64(7)) * _MIX[2]
    out = np.stack([one, two + np.uint64(1), three + np.uint64(2)], axis=1)
    out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return (out >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), rows


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language.

    Up to six languages have the exhaustive code: all splits, each once. More have rows of a
    pseudo-random code of 15 bits per doubling, drawn until every two rows are far apart.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.stack([np.ones(len(splits)), *(np.where(splits >> k & 1, -1.0, 1.0) for k in range(n - 1))])
    bits = 15 * int(np.ceil(np.log2(n)))
    draw, best, far = np.random.Generator(np.random.PCG64(n)), None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = (code.shape[1] - (code @ code.T) + np.eye(n) * 4 * bits).min() / 2
        if least > far:
            best, far = code, least
    return best


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices(texts, 200_000):
            found, rows = grams(texts[lo:hi])
            for lang in set(langs[lo:hi]):
                own = np.repeat(np.array([x == lang for x in langs[lo:hi]]), np.diff(rows))
                kept = np.bincount(found[own].ravel(), minlength=BUCKETS)
                total[lang] = total.get(lang, 0) + kept
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Languages, their codewords and a weight of every bucket for every bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs))
        share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
        weights = []
        for bit in self.code.T:
            sides = [np.log(share[bit == s].mean(axis=0)) if (bit == s).any() else 0.0 for s in (1.0, -1.0)]
            weights.append(sides[0] - sides[1] if (bit < 0).any() and (bit > 0).any() else np.zeros(BUCKETS))
        self.weights = np.stack(weights, axis=1).astype(np.float32) if langs else np.zeros((BUCKETS, 1), np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of every text."""
        found, rows = grams(texts)
        n = np.diff(rows)
        known = (n > 0) & bool(self.langs)
        names, score, close = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not known.any():
            return names.tolist(), score, close
        each = self.weights[found[:, 0]] + self.weights[found[:, 1]] + self.weights[found[:, 2]]
        sums = np.add.reduceat(each, rows[:-1][known], axis=0, dtype=np.float64)
        margin = sums / n[known, None] * np.minimum(n[known, None], ENOUGH_LETTERS) / 3
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).sum(axis=2)
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        names[known] = np.array(self.langs, object)[best]
        score[known] = chance[np.arange(len(best)), best]
        close[known] = score[known] < AMBIGUOUS
        return names.tolist(), score, close


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of every document that is labelled and not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = known.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow().to_pydict()
    langs = sorted(set(found["lang"]))
    counts = np.zeros((len(langs), BUCKETS))
    place = {x: k for k, x in enumerate(langs)}
    np.add.at(counts, ([place[x] for x in found["lang"]], found["bucket"]), found["n"])
    return Model(langs, counts)


def _judged(docs: DataFrame, model: Model | None, out: str) -> DataFrame:
    """``docs`` with the struct ``out`` of ``lang_pred, score, ambiguous``."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.code, model.weights))

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model.__new__(Model)
        own.langs, own.code, own.weights = shared.value
        for series in batches:
            texts = [t or "" for t in series]
            parts = [own.predict(texts[lo:hi]) for lo, hi in slices(texts, 200_000)]
            langs, score, close = ([x for p in parts for x in p[k]] for k in range(3))
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(score, dtype=float), "ambiguous": pd.Series(close, dtype=bool)})

    return docs.withColumn(out, judge(F.col("text").cast("string")))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with ``lang_pred, score, ambiguous``, which hide columns of those names."""
    rows = _judged(docs.drop("lang_pred", "score", "ambiguous"), model, "_judged")
    return rows.select("*", "_judged.*").drop("_judged")


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows whose language is recognised: neither ``und`` nor ambiguous; all their columns as they are."""
    name = "_judged"
    while name in docs.columns:
        name += "_"
    rows = _judged(docs, model, name)
    return rows.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & ~F.col(f"{name}.ambiguous")).drop(name)

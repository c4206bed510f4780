"""Vector expressions: sign codes, int8 codes and similarities without Python, and stored bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

CODE_BITS = 64


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def sign_code(v) -> Column:
    """One long per 64 dimensions; bit i is set where the value is 0 or more. NaN sets none."""
    v = _col(v)
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CODE_BITS).cast("int"))

    def word(w: Column) -> Column:
        part = F.slice(v, w * CODE_BITS + 1, CODE_BITS)
        bits = F.transform(part, lambda x, i: F.when((x >= 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.transform(words, word)


def hamming(a, b) -> Column:
    """Differing bits of two sign codes."""
    both = F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    return F.aggregate(both, F.lit(0), lambda n, x: n + x)


def dot(a, b) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine_of(a, b, norms: Column) -> Column:
    """Cosine from the product of both norms; 0 where the sizes differ or a vector is zero."""
    usable = (F.size(_col(a)) == F.size(_col(b))) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(F.lit(0.0))


def cosine(a, b) -> Column:
    return cosine_of(a, b, norm(a) * norm(b))


def int8_scale(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x).cast("double"))) / 127


def int8_code(v, scale) -> Column:
    """Rounded half away from zero and clamped; a zero vector has a zero code."""
    scale = _col(scale)
    level = lambda x: F.greatest(F.least(F.round(x.cast("double") / scale), F.lit(127.0)), F.lit(-128.0))
    return F.transform(_col(v), lambda x: F.when(scale > 0, level(x)).otherwise(0.0).cast("byte"))


def int8_score(query, code, scale) -> Column:
    """Inner product of a full query with a quantised vector."""
    return dot(query, code) * _col(scale)


def dequantise(code, scale) -> Column:
    return F.transform(_col(code), lambda x: x.cast("double") * _col(scale))


def bounded_score(raw, query) -> Column:
    """A raw inner product as a similarity from 0 to 1."""
    size = norm(query)
    return F.when(size > 0, F.greatest(F.least(_col(raw) / size, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


@F.pandas_udf(BinaryType())
def encoded(vectors: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decoded(raw: pd.Series) -> pd.Series:
    """The vector of such bytes; null where a value is cut short."""
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

"""Vectorised word and shingle hashing over batches of texts (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROLES = _SEED.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)

#: Word separators of the contract: space and U+0009 to U+000D.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER_ASCII = np.arange(256, dtype=np.uint8)
_LOWER_ASCII[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


@lru_cache(2)
def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    return _powers(n, _BASE), _powers(n, np.uint64(pow(int(_BASE), -1, 2**64)))


def hashed_runs(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every maximal run of bytes of ``raw`` that is ``inside``.

    A run's sum is a difference of running sums over all bytes, taken back by its place.
    """
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    scale = 1 << max(20, int(len(raw) - 1).bit_length())
    up, down = _scales(scale) if scale == 1 << 20 else _scales.__wrapped__(scale)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and the offsets of each text's words.

    Words are maximal runs of bytes other than the separators, A-Z lower-cased.
    """
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    hashes, starts, _ = hashed_runs(_LOWER_ASCII[raw], ~_SEPARATOR[raw])
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(b) + 1 for b in blobs)]))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size``-word shingles of one text; the whole text where it has fewer words."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mix(np.add.reduce(words * _ROLES[:n], keepdims=True) + np.uint64(n))
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total += words[k : n - size + 1 + k] * _ROLES[k]
    return mix(total + np.uint64(size))


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    for k in range(len(texts)):
        yield np.unique(shingle_hashes(words[at[k] : at[k + 1]], size))


def slices(texts: list[str], limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters, so that working arrays stay small."""
    start = used = 0
    for k, t in enumerate(texts):
        if used and used + len(t) > limit:
            yield start, k
            start, used = k, 0
        used += len(t)
    if start < len(texts):
        yield start, len(texts)


def small(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of about ``limit`` bytes, so that few become Python objects at once."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)

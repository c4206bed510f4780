"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

Each document's set of word shingles is hashed once. A register per bucket keeps the bucket's
smallest hash as a leading-zero count and ten mantissa bits. Bands of registers (empty ones
borrow from a random filled one, for banding only) give candidate buckets; the Jaccard index
estimated from the registers, corrected for accidental collisions, drops the hopeless pairs; the
rest are verified on the full shingle sets. The parities of the buckets' sizes bound the sets'
difference from below, which refutes most pairs of large buckets without reading either set.

Defined cases: null and blank texts have no shingles and link with nothing; a text with fewer
words than a shingle is one shingle; rows that repeat a ``doc_id`` count as one document; rows
without ``doc_id`` are returned, kept and never linked; equal sets are one node before any
banding, so groups of copies cost one row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrays import mix, shingle_sets, slices
from threadloom.llm.linking import components, link_buckets
from threadloom.llm.work import free, save, scratch

BUCKET_BITS = 9
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS = 8
BANDS = REGISTERS // ROWS
_BORROW = np.random.Generator(np.random.PCG64(47)).integers(0, 2**32, (REGISTERS, REGISTERS), dtype=np.uint32)
_BAND_LAYOUT = np.random.Generator(np.random.PCG64(41)).permutation(REGISTERS).reshape(BANDS, ROWS)
_BAND_ROLES = np.random.Generator(np.random.PCG64(43)).integers(0, 2**64, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 registers of sorted distinct hashes: 0 is empty, else zeros and mantissa, plus one."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = (hashes[first] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    # frexp on the upper 52 bits is exact, so the exponent gives the leading zeros
    upper = (low >> np.uint64(12)).astype(np.float64)
    zeros = np.minimum(52 - np.frexp(upper)[1], 52)
    mantissa = ((low << zeros.astype(np.uint64)) << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out[bucket[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) + mantissa.astype(np.uint16) + np.uint16(1)
    return out


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each bucket holds an odd number of the distinct hashes, as bits of int64 words.

    Two sets differ in at least as many hashes as their parities differ in bits.
    """
    odd = np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=REGISTERS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _within(percent: int):
    """Whether two marks (n, parities) leave room for a Jaccard index of ``percent``.

    100 * i >= percent * (a + b - i) means (100 + percent) * (a + b - 2i) <= (100 - percent) * (a + b).
    """

    def possible(a: Column, b: Column) -> Column:
        bits = sum((F.bit_count(a["parity"][k].bitwiseXOR(b["parity"][k])) for k in range(REGISTERS // 64)), F.lit(0))
        return bits * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent)

    return possible


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; an empty register borrows from a filled one.

    Each empty register has its own random order of all registers and takes the first filled one,
    so that registers agree independently, also where a small set fills few of them.
    """
    filled, empty = np.flatnonzero(sketch), np.flatnonzero(sketch == 0)
    values = sketch.astype(np.uint64)
    if len(empty):
        source = filled[_BORROW[np.ix_(empty, filled)].argmin(axis=1)]
        values[empty] = values[source] + (source.astype(np.uint64) << np.uint64(16))
    total = (values[_BAND_LAYOUT] * _BAND_ROLES[:, :ROWS]).sum(axis=1, dtype=np.uint64)
    return mix(total + _BAND_ROLES[:, ROWS])


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that the registers of two unrelated sets of these sizes agree.

    The minimum of m hashes has z leading zeros with chance (1-2^-(z+1))^m - (1-2^-z)^m; equal
    leading zeros leave the mantissa bits to chance.
    """
    z = np.arange(53, dtype=np.float64)
    out = []
    for n in (a, b):
        m = np.maximum(np.asarray(n, dtype=np.float64) / REGISTERS, 1.0)[:, None]
        out.append((1 - 2.0 ** -(z + 1)) ** m - (1 - 2.0**-z) ** m)
    return (out[0] * out[1]).sum(axis=1) / (1 << MANTISSA_BITS)


def estimate(sketch_a: np.ndarray, sketch_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates and the number of registers each rests on."""
    used = ((sketch_a > 0) | (sketch_b > 0)).sum(axis=1)
    same = ((sketch_a == sketch_b) & (sketch_a > 0)).sum(axis=1)
    chance = collision_rate(size_a, size_b)
    raw = same / np.maximum(used, 1)
    return np.clip((raw - chance) / (1 - chance), 0, 1), used


def _profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                rows = []
                for s in shingle_sets(texts[lo:hi], size):
                    if len(s):
                        rows.append((len(s), int(s.sum().view(np.int64)), int(mix(s).sum().view(np.int64)), registers(s).tobytes(), parities(s)))
                    else:
                        rows.append((0, None, None, None, None))
                n, f1, f2, sketch, parity = zip(*rows)
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(parity, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "f1", "f2", "sketch", "parity"])

    return run


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, shingle count, 128-bit set fingerprint, registers and parities of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_profiles(size), "doc_id long, n_shingles long, f1 long, f2 long, sketch binary, parity array<long>")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            keys = np.concatenate([band_keys(np.frombuffer(x, dtype=np.uint16)) for x in part.column(1).to_pylist()])
            ids = np.repeat(part.column(0).to_numpy(), BANDS)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ids)], ["key", "id"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                sets = [pa.array(s.view(np.int64)) for s in shingle_sets(texts[lo:hi], size)]
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                items = pa.concat_arrays(sets).cast(pa.int64())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), items)], ["id", "items"])

    return run


def _plausible(least: float):
    @F.pandas_udf("boolean")
    def check(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(sa):
            return pd.Series([], dtype=bool)
        known = sa.notna() & sb.notna()
        blank = bytes(2 * REGISTERS)
        a, b = (np.frombuffer(b"".join(y if y is not None else blank for y in x), dtype=np.uint16).reshape(-1, REGISTERS) for x in (sa, sb))
        value, used = estimate(a, b, na.fillna(1).to_numpy(), nb.fillna(1).to_numpy())
        # six standard errors: no true link is lost to the estimate
        margin = 6 * math.sqrt(least * (1 - least)) / np.sqrt(np.maximum(used, 1)) + 0.01
        return pd.Series(value >= least - margin) | ~known

    return check


def _ratio(percent: int, a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents link where 100 * |intersection| >= percent * |union| of their ``size``-word shingle
    sets; ``component_id`` is the smallest doc_id that links reach and ``kept`` marks it.
    """
    with scratch() as kept:
        made = save(profiles(docs, size))
        names = save(made.select("doc_id", "n_shingles", "f1", "f2"))
        full = names.filter("n_shingles > 0 and doc_id is not null")
        nodes = made.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2")
        nodes = save(nodes.agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")))
        free(made)
        members = nodes.select("rep", "sketch").mapInArrow(_bands, "key long, id long").distinct()
        sketches = nodes.select(F.col("rep").alias("id"), "n", "sketch", F.struct("n", "parity").alias("mark"))
        if _repeats(nodes):
            # a doc_id that stands for several sets has no sketch of its own: only full sets decide on it
            one = F.count("*") == 1
            sketches = sketches.groupBy("id").agg(*[F.when(one, F.first(c)).alias(c) for c in ("n", "sketch", "mark")])

        def verify(pairs: DataFrame) -> DataFrame:
            a = sketches.select(F.col("id").alias("u"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
            b = sketches.select(F.col("id").alias("v"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
            near = pairs.join(a, "u").join(b, "v").filter(F.coalesce(_ratio(percent, "na", "nb"), F.lit(True)))
            near = save(near.filter(_plausible(percent / 100)("sa", "sb", "na", "nb")).select("u", "v"))
            ids = near.select(F.col("u").alias("doc_id")).union(near.select(F.col("v").alias("doc_id"))).distinct()
            texts = docs.select("doc_id", "text").join(save(ids), "doc_id", "left_semi")
            sets = save(texts.mapInArrow(_sets(size), "id long, items array<long>"))
            left = sets.select(F.col("id").alias("u"), F.col("items").alias("x"))
            right = sets.select(F.col("id").alias("v"), F.col("items").alias("y"))
            both = near.join(left, "u").join(right, "v").withColumn("common", F.size(F.array_intersect("x", "y")))
            return both.filter(F.col("common") * 100 >= (F.size("x") + F.size("y") - F.col("common")) * percent).select("u", "v").distinct()

        labels = link_buckets(members, verify, _within(percent), sketches.select("id", "mark"))
        # a doc_id on rows with different texts ties their sets together
        ties = full.groupBy("doc_id").agg(F.min("f1").alias("g1"), F.max("f1").alias("g2")).filter("g1 <> g2").select("doc_id")
        tied = full.join(save(ties), "doc_id").select("doc_id", "f1", "f2").join(nodes.select("f1", "f2", "rep"), ["f1", "f2"])
        tied = save(tied.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
        if not tied.isEmpty():
            labels = components(tied.union(labels.select(F.col("id").alias("u"), F.col("component").alias("v"))))
        groups = nodes.select("f1", "f2", "rep", "last").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        groups = save(groups.filter("component is not null or last <> rep").select("f1", "f2", F.coalesce("component", "rep").alias("component_id")))
        kept += [names, groups]
    out = names.join(groups, ["f1", "f2"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def _repeats(nodes: DataFrame) -> bool:
    """Whether one doc_id stands for several sets (rows that repeat an id)."""
    return not nodes.groupBy("rep").count().filter("count > 1").isEmpty()


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is its component's smallest id; others go."""
    with scratch() as kept:
        gone = save(near_duplicates(docs, size, percent).filter("not kept").select("doc_id").distinct())
        kept.append(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)

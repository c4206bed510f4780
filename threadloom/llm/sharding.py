"""Sharding by extendible hashing.

A directory over hash-prefix bits maps every row to a shard. Only buckets above the byte limit
are split on another bit, until each fits. Bytes are first added up by a fine prefix, so the
directory is built from a small table; only buckets that this prefix leaves too large are counted
again on more bits. DataFrame expressions only.

Defined cases: null texts have no bytes; rows without key hash as the empty string; rows that
repeat a key share all hash bits, so where the last bit leaves a bucket too large it stays one
shard and is marked ``oversized``, as is a single row above the limit; an empty table gives an
empty result; extra columns are kept unless the operator's own names hide them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.work import save

HASH_BITS = 60
DEFAULT_LIMIT = 256 << 20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5, so that any engine can follow the directory."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(bits: int, h: str = "hash60") -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaves ``(depth, prefix, bytes, oversized)`` of the split tree over ``sizes (hash60, bytes)``.

    The depth of a leaf is the least one at which its bucket's bytes fit the limit.
    """
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    leaves, floor, rest = [], 0, sizes
    bits = min(HASH_BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    while True:
        fine = save(rest.groupBy(_prefix(bits).alias("fine")).agg(F.sum("bytes").alias("bytes")))
        steps = fine.select("bytes", F.explode(F.sequence(F.lit(floor), F.lit(bits))).alias("depth"), "fine")
        sums = steps.groupBy("depth", F.expr(f"shiftright(fine, {bits} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        sums = save(sums)
        over = sums.filter(F.col("bytes") > limit)
        # a fitting bucket is a leaf where the bucket above it is over the limit (or it is the root)
        above = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        fits = sums.filter(F.col("bytes") <= limit).withColumn("up", F.shiftright("prefix", 1))
        root = fits.filter(F.col("depth") == 0) if floor == 0 else fits.limit(0)
        inner = fits.filter(F.col("depth") > floor).join(above, ["depth", "up"], "left_semi")
        leaves.append(root.select("depth", "prefix", "bytes", F.lit(False).alias("oversized")))
        leaves.append(inner.select("depth", "prefix", "bytes", F.lit(False).alias("oversized")))
        deep = save(over.filter(F.col("depth") == bits).select(F.col("prefix").alias("fine"), "bytes"))
        if deep.isEmpty():
            break
        if bits == HASH_BITS:
            leaves.append(deep.select(F.lit(bits).alias("depth"), F.col("fine").alias("prefix"), "bytes", F.lit(True).alias("oversized")))
            break
        rest = rest.join(deep.select("fine"), _prefix(bits) == F.col("fine"), "left_semi")
        floor, bits = bits, min(HASH_BITS, bits + 8)
    return save(reduce(DataFrame.union, leaves))


def assign_shards(df: DataFrame, key: Column, n_bytes: Column, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``df`` with ``hash60, n_bytes, shard_depth, shard_prefix, shard_bytes, oversized``."""
    own = ["hash60", "n_bytes", "shard_depth", "shard_prefix", "shard_bytes", "oversized"]
    rows = df.withColumns({"_h": key_hash(key), "_b": F.coalesce(n_bytes, F.lit(0)).cast("long")}).drop(*own)
    rows = rows.withColumnsRenamed({"_h": "hash60", "_b": "n_bytes"})
    leaves = directory(rows.select("hash60", F.col("n_bytes").alias("bytes")), limit)
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    # one directory slot for every leaf at each row's depth: a row tries each depth in use
    tries = rows.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths]))) if depths else rows.withColumn("_t", F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    named = leaves.select(F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), F.col("bytes").alias("shard_bytes"), "oversized")
    on = (F.col("_t.depth") == F.col("shard_depth")) & (F.col("_t.prefix") == F.col("shard_prefix"))
    return tries.join(named, on).drop("_t")


def write_shards(df: DataFrame, path: str, key: Column, n_bytes: Column, limit: int = DEFAULT_LIMIT) -> None:
    """Write the rows as Parquet, one folder per shard."""
    rows = assign_shards(df, key, n_bytes, limit)
    shard = F.concat_ws("-", F.col("shard_depth"), F.hex("shard_prefix")).alias("shard")
    rows.select(*df.columns, shard).repartition("shard").write.partitionBy("shard").parquet(path)

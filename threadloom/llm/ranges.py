"""Dealing rows by ranges of an id, from approximate quantiles of that id alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST = -(2**63)


def range_of(df: DataFrame, key: Column, n: int) -> Column:
    """The number of the range, of about ``n`` even ones, that holds ``key``; ranges ascend.

    The driver sees one cut per range. Null keys count as the lowest. Only the columns of ``key``
    are read for the cuts, so whatever else ``df`` computes is not computed for them.
    """
    key = F.coalesce(key.cast("long"), F.lit(LOWEST))
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] if n > 1 else None
    cuts = sorted(set(found or [0]))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    table = F.lit(cuts)

    def seek(at: Column, step: Column) -> Column:
        fits = (at + step <= len(cuts)) & (F.get(table, at + step - 1) < key)
        return at + F.when(fits, step).otherwise(0)

    return F.aggregate(F.lit(steps), F.lit(0), seek)


def shuffle_partitions(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

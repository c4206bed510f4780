"""Running sums within a key whose rows need not fit in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.scratch import save


def suffix_sums(rows: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over a row and all rows after it in ``order`` within ``key``.

    Rows are dealt by ranges of key and order, each range is added up alone, and what the later
    ranges of the key hold comes on top: a key's ranges, not its rows, meet in one task. ``order``
    must tell all rows of a key apart; a null value counts nothing.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = save(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()))
    value = F.coalesce(F.col(value), F.lit(0))
    sums = dealt.groupBy(key, "_part").agg(F.sum(value).alias("_sum"))
    later = F.sum("_sum").over(Window.partitionBy(key).orderBy("_part").rowsBetween(1, Window.unboundedFollowing))
    sums = sums.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(later, F.lit(0)).alias("_later"))
    own = F.sum(value).over(Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = dealt.withColumn("_own", own).join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return both.withColumn(out, F.col("_own") + F.col("_later")).drop("_part", "_own", "_key", "_of", "_later")

"""Threshold-scaled document fingerprints (every shingle hash below a fixed fraction is kept).

Because the threshold is fixed, fingerprints of parts merge by union, and two fingerprints
estimate containment whatever the sizes of their documents. DataFrame expressions only.

Defined cases: null is the empty text; a text without shingles, or none of whose hashes falls
below the threshold (one in 1.3 texts of one shingle, one in 18 of ten), has an empty fingerprint,
which tells nothing: its likeness is 0 to all but the fingerprint of an equal text, to which it is
1; equal texts have equal fingerprints; rows that repeat a doc_id follow each other in text order;
rows without doc_id come last; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.native import with_shingles
from threadloom.llm.ranges import LOWEST, range_of, shuffle_partitions

#: One of this many hashes is kept.
SCALE = 4
#: Ranges of doc_id that are dealt to each shuffle partition.
RANGES = 4
WORDS = 5
_LOWEST = -(2**63)


def with_sketch(df: DataFrame, text: Column, out: str, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """Add ``out``: the sorted distinct shingle hashes below ``1/scale`` of the hash range."""
    ceiling = F.lit(_LOWEST + 2**64 // scale)
    df = with_shingles(df, text, words, "_all")
    return df.withColumn(out, F.sort_array(F.array_distinct(F.filter("_all", lambda h: h < ceiling)))).drop("_all")


def merged(*sketches: str) -> Column:
    """The sketch of the union of the documents."""
    return F.sort_array(reduce(F.array_union, map(F.col, sketches)))


def containment(a: str, b: str, same: Column | bool = False) -> Column:
    """Share of the smaller sketch that the other holds, 0 to 1; an empty one holds nothing.

    ``same`` says that both belong to equal texts, so that the likeness is 1.
    """
    least = F.least(F.size(a), F.size(b))
    same = F.lit(same) if isinstance(same, bool) else same
    return F.when(same, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least).cast("double")


def printed(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<c>`` of the document with the next smaller doc_id; after the last, of the first.

    Rows are dealt by ranges of doc_id, several for each shuffle partition, of which the driver
    sees the approximate quantiles and the highest id. The first row of each range is copied to
    the end of the range before it, so that no row needs a global window.
    """
    spark = docs.sparkSession
    lowest = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    keyed = docs.withColumns({"_k": lowest, "_range": range_of(docs, F.col("doc_id"), RANGES * shuffle_partitions(docs))})
    tops = sorted((r["_range"], r["h"]) for r in keyed.groupBy("_range").agg(F.max("_k").alias("h")).collect())
    if not tops:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    ranges = [r for r, _ in tops]
    before = spark.createDataFrame(list(zip([h for _, h in tops], [*ranges[1:], ranges[0]])), "_k long, _copy int")
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost"))
    copy = F.struct(F.col("_copy").alias("r"), F.lit(True).alias("ghost"))
    at = F.explode(F.when(F.col("_copy").isNotNull(), F.array(own, copy)).otherwise(F.array(own))).alias("_at")
    dealt = keyed.join(F.broadcast(before), "_k", "left").select(*docs.columns, "_k", at)
    order = Window.partitionBy("_at.r").orderBy("_at.ghost", F.desc("_k"), columns[0])
    ahead = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return ahead.filter("not _at.ghost").drop("_k", "_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last third replaced by the beginning of the next document's text.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_sketch(rows, F.col("text"), "sketch")
    rows = with_next(rows, ["text", "sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    head = F.col("text").substr(F.lit(1), (F.col("n_chars") - third).cast("int"))
    rows = rows.withColumn("edited", F.concat(head, F.col("next_text").substr(F.lit(1), third)))
    rows = with_sketch(rows, F.col("edited"), "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed("sketch").alias("fingerprint"),
        printed("edited_sketch").alias("edited_fingerprint"),
        containment("sketch", "edited_sketch", F.col("text") == F.col("edited")).alias("near_edited"),
        containment("sketch", "next_sketch", F.col("text") == F.col("next_text")).alias("near_next"),
    )

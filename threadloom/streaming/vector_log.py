"""A table of vectors that a stream keeps up to date: batches, commits and compaction.

A micro-batch writes the last vector of each (message, chunk, model) that it brings into a folder of
its number, and then a commit of that number; readers see committed batches only, and of each key
the latest. A batch that is run again finds its commit and does nothing, one that died before its
commit is written anew. ``compact`` folds committed batches into a base, so that readers merge few
folders; stored by model, a reader of one model reads its folders alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.ingest import VECTOR_KEY
from threadloom.operators.retrieval import coded

SCHEMA = "message_id string, chunk_index int, seq long, scale double, sign array<bigint>, code array<tinyint>, batch_id long, model_id string"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers that name the entries of a folder; other names are passed over."""
    fs, path = _files(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = [s.getPath().getName().rpartition("=")[2] for s in fs.listStatus(path(folder))]
    return sorted(int(n) for n in names if n.isdigit())


def committed(spark: SparkSession, folder: str) -> list[int]:
    return _numbers(spark, f"{folder}/commits")


def commit(spark: SparkSession, folder: str, kind: str, number: int) -> None:
    """Mark a number as done; an empty file appears whole or not at all."""
    fs, path = _files(spark, folder)
    fs.create(path(f"{folder}/{kind}/{number}"), True).close()


def _latest(rows: DataFrame) -> DataFrame:
    """One row of each key: of the last batch, and in it the last by ``seq``."""
    rest = [c for c in rows.columns if c not in VECTOR_KEY]
    last = rows.groupBy(*VECTOR_KEY).agg(F.max_by(F.struct(*rest), F.struct("batch_id", "seq")).alias("b"))
    return last.select(*VECTOR_KEY, "b.*")


def put(batch: DataFrame, batch_id: int, folder: str) -> bool:
    """Write and commit ``batch (message_id, chunk_index, model_id, vector, seq)``; False where that was done before.

    Null and empty vectors are left out. Rows of a key with equal ``seq`` are equal.
    """
    spark = batch.sparkSession
    if batch_id in committed(spark, folder) or batch_id <= max(_numbers(spark, f"{folder}/bases"), default=-1):
        return False
    rows = batch.filter("size(vector) > 0").select(F.col("message_id").cast("string").alias("message_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "model_id", F.col("seq").cast("long").alias("seq"), "vector")
    rows = _latest(coded(rows).withColumn("batch_id", F.lit(batch_id).cast("long")))
    rows.write.mode("overwrite").partitionBy("model_id").parquet(f"{folder}/data/batch={batch_id}")
    commit(spark, folder, "commits", batch_id)
    return True


def current(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    """The latest coded vector of every key, of one model or of all."""
    base = max(_numbers(spark, f"{folder}/bases"), default=None)
    later = [n for n in committed(spark, folder) if base is None or n > base]
    places = ([f"{folder}/base/upto={base}"] if base is not None else []) + [f"{folder}/data/batch={n}" for n in later]
    out = None
    for place in places:
        rows = spark.read.schema(SCHEMA).parquet(place)
        out = rows if out is None else out.unionByName(rows)
    out = spark.createDataFrame([], SCHEMA) if out is None else out
    return _latest(out if model is None else out.filter(F.col("model_id") == model))


def compact(spark: SparkSession, folder: str) -> int | None:
    """Fold all committed batches into a base and delete them; the number that the base reaches, or None."""
    numbers = committed(spark, folder)
    if not numbers:
        return max(_numbers(spark, f"{folder}/bases"), default=None)
    upto, before = numbers[-1], _numbers(spark, f"{folder}/bases")
    current(spark, folder).write.mode("overwrite").partitionBy("model_id").parquet(f"{folder}/base/upto={upto}")
    commit(spark, folder, "bases", upto)
    fs, path = _files(spark, folder)
    for n in numbers:
        fs.delete(path(f"{folder}/commits/{n}"), False)
        fs.delete(path(f"{folder}/data/batch={n}"), True)
    for n in before:
        fs.delete(path(f"{folder}/bases/{n}"), False)
        fs.delete(path(f"{folder}/base/upto={n}"), True)
    return upto


def merge_vectors(stream: DataFrame, folder: str, checkpoint: str):
    """Keep ``folder`` up to date with a stream of vectors; the source's ``maxFilesPerTrigger`` bounds a batch."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: put(batch, batch_id, folder) and None).option("checkpointLocation", checkpoint)

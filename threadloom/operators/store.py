"""Messages, their chunks and vectors as one unit: a batch is searchable as a whole or not at all.

A batch's messages, chunks and vectors are written below its number, then one commit; readers see
committed batches, and of a message that came more than once the last batch's, with the chunks and
vectors of that batch alone. A batch that is put in again changes nothing, one that died before its
commit is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import ingest
from threadloom.operators.scoring import Embedder, embedded
from threadloom.streaming.vector_log import commit, committed

TABLES = ("messages", "chunks", "vectors")


def closed(messages: DataFrame) -> DataFrame:
    """``messages (id, thread_id, content)`` without those that make or answer a call that the batch does not close.

    A call is closed where its thread has exactly one call and one result of that id in the batch;
    a call without id never is. Null content has no calls.
    """
    blocks = messages.select("id", "thread_id", F.explode("content").alias("b")).filter("b.kind in ('tool_call', 'tool_result')").select("id", "thread_id", F.coalesce("b.call_id", F.lit("")).alias("call_id"), F.col("b.kind").alias("kind"))
    counts = blocks.groupBy("thread_id", "call_id").agg(F.count_if(F.col("kind") == "tool_call").alias("calls"), F.count_if(F.col("kind") == "tool_result").alias("results"))
    open_ = counts.filter("calls <> 1 or results <> 1 or call_id = ''")
    return messages.join(blocks.join(open_, ["thread_id", "call_id"]).select("id").distinct(), "id", "left_anti").select(messages.columns)


def put(messages: DataFrame, batch_id: int, folder: str, embedder: Embedder, model: str, most: int = T.CHUNK_BYTES, overlap: int = T.OVERLAP_BYTES) -> bool:
    """Store a batch of ``messages (id, thread_id, role, position, content)``; False where it is stored already.

    Messages of open calls stay out. Whatever fails on the way, the embedder included, leaves the
    store as it was.
    """
    spark = messages.sparkSession
    if batch_id in committed(spark, folder):
        return False
    place = lambda table: f"{folder}/{table}/batch={batch_id}"
    closed(messages).write.mode("overwrite").parquet(place("messages"))
    stored = spark.read.schema(messages.schema).parquet(place("messages"))
    ingest.chunked(stored, most, overlap).write.mode("overwrite").parquet(place("chunks"))
    chunks = spark.read.schema("id string, chunk_index int, text string, byte_start int, byte_end int, tokens int").parquet(place("chunks"))
    texts = chunks.select(F.col("id").alias("message_id"), "chunk_index", "text")
    facts = stored.select(F.col("id").cast("string").alias("message_id"), "thread_id", "role")
    embedded(texts, embedder, "document", model).drop("text").join(facts, "message_id").write.mode("overwrite").parquet(place("vectors"))
    commit(spark, folder, "commits", batch_id)
    return True


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table of the store (``messages``, ``chunks`` or ``vectors``) as committed; None while nothing is."""
    if table not in TABLES:
        raise ValueError(f"{table} is none of {TABLES}")
    numbers = committed(spark, folder)
    if not numbers:
        return None
    read = lambda name: spark.read.option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/batch={n}" for n in numbers])
    last = read("messages").groupBy(F.col("id").cast("string").alias("_id")).agg(F.max("batch").alias("_batch"))
    rows, key = read(table), "message_id" if table == "vectors" else "id"
    return rows.join(last, (F.col(key).cast("string") == F.col("_id")) & (F.col("batch") == F.col("_batch"))).drop("_id", "_batch", "batch")

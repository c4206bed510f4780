"""What is stored of a message: its chunks, their vectors and the keys that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.functions import text as T
from threadloom.operators import tables

VECTOR_KEY = ("message_id", "chunk_index", "model_id")


def chunk_key(message: Column, index: Column) -> Column:
    """One text for a message and the number of its chunk, with a NUL between them."""
    return F.concat(message.cast("string"), F.lit("\0"), index.cast("string"))


def key_parts(key: Column) -> tuple[Column, Column]:
    """The message and the number of a chunk key; 0 where the number is missing or malformed."""
    at = F.instr(key, "\0")
    message = F.when(at > 0, F.substring(key, F.lit(1), at - 1)).otherwise(key)
    index = F.when(at > 0, F.substring(key, at + 1, F.length(key)))
    return message, F.coalesce(F.when(index.rlike("^[0-9]{1,9}$"), index.cast("int")), F.lit(0))


def stamped(rows: DataFrame, column: str = "created_at") -> DataFrame:
    """Rows without a time get the time of the query."""
    return rows.withColumn(column, F.coalesce(column, F.current_timestamp()))


def chunked(messages: DataFrame, most: int = T.CHUNK_BYTES, overlap: int = T.OVERLAP_BYTES) -> DataFrame:
    """The chunks of every message ``(id, role, content)``, cut from the form in which it is scored."""
    return T.chunks(messages.select("id", B.for_scoring(F.col("role"), F.col("content")).alias("text")), "id", most, overlap)


def put_vectors(base: DataFrame, rows: DataFrame, messages: DataFrame) -> DataFrame:
    """``base`` with vectors ``(message_id, chunk_index, model_id, vector, seq)``, the last of a key in place of those before.

    Thread and role of the message are kept with the vector, so that scans need no join; vectors
    of unknown messages don't go in.
    """
    last = tables.newest(rows, list(VECTOR_KEY), F.col("seq")).drop("seq")
    facts = messages.select(F.col("id").alias("message_id"), "thread_id", "role")
    return tables.upsert(base, last.join(facts, "message_id"), list(VECTOR_KEY))


def of_model(vectors: DataFrame, model: str) -> DataFrame:
    """One model's vectors; stored by model, the filter prunes folders."""
    return vectors.filter(F.col("model_id") == model)


def wanted(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """The vectors of ``keys (message_id, chunk_index, model_id)``."""
    return vectors.join(keys.select(*VECTOR_KEY).distinct(), list(VECTOR_KEY), "left_semi")


def of_one_width(vectors: DataFrame, width: int) -> DataFrame:
    """``vectors``; a row of another width is an error when it is read."""
    wrong = F.concat(F.lit(f"a vector has not {width} values but "), F.size("vector").cast("string"))
    checked = F.when(F.size("vector") == width, F.col("vector")).otherwise(F.raise_error(wrong).cast(vectors.schema["vector"].dataType))
    return vectors.withColumn("vector", checked)

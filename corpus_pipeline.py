"""A training corpus from raw documents, in five stages.

Each stage takes all that the one before it kept; ``run`` writes every stage's rows as Parquet to
shared storage and reads them back, so that no stage depends on the lineage of another, and then
deletes what the stage before wrote.

Defined cases, for all stages: an empty table gives an empty one; all but the last stage keep all
columns, whatever their names. A null or empty text has no language, so its row goes in the first
stage; a text that loses all its lines in the second is empty from then on and stays. Rows that
repeat doc_id and text are treated alike, so all go or all stay. Rows without doc_id pass: they
keep their lines only where no document with an id has them later in order, and are never near
duplicates or leaks; the packing takes each of them as a document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.decontaminate import drop_leaks
from threadloom.llm.langid import keep_known
from threadloom.llm.line_dedup import drop_repeated_lines
from threadloom.llm.near_dedup import drop_near_duplicates
from threadloom.llm.packing import pack
from threadloom.llm.queries import tokenizer_path
from threadloom.llm.work import free, save, scratch

#: SQL has no n-gram classifiers, SimHash or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None

#: Bytes of an Arrow batch at most; Python workers live through all stages, and so does what large batches make them hold.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    """``stage`` after bounding the session's Arrow batches, as its rows are read after it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that others already have; n_chars follows the text."""
    out = drop_repeated_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return drop_near_duplicates(docs).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see the packing operator for the columns."""
    pieces = pack(docs, tokenizer_path(), end_id=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    (name, _small_batches(stage))
    for name, stage in (
        ("language", language),
        ("lines", lines),
        ("near_duplicates", near_duplicates),
        ("benchmark", benchmark),
        ("packing", packing),
    )
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = docs
        with scratch() as kept:
            docs = save(stage(spark, before, sf_dir))
            kept.append(docs)
        free(before)
    return docs

"""Changes to tables as DataFrames: upserts, replacements, cascades and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_KEY = ("from_id", "to_id", "source")


def newest(df: DataFrame, keys: list[str], by: Column, *ties: str) -> DataFrame:
    """One row per key, the one that ``by`` puts last."""
    order = Window.partitionBy(*keys).orderBy(by.desc(), *ties)
    return df.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def upsert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with ``rows`` put in by key; ``rows`` have a key once."""
    return base.join(rows.select(*keys), keys, "left_anti").select(base.columns).unionByName(rows.select(base.columns))


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with those ``rows`` whose key it lacks: what was first stays."""
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti").select(base.columns))


def replace_children(base: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``rows`` are replaced."""
    return base.join(rows.select(parent).distinct(), parent, "left_anti").select(base.columns).unionByName(rows.select(base.columns))


def delete_threads(gone: DataFrame, messages: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and edges without the threads ``gone (thread_id)``; an edge goes with either end."""
    kept = messages.join(gone.select("thread_id"), "thread_id", "left_anti").select(messages.columns)
    for end in ("from_thread", "to_thread"):
        edges = edges.join(gone.select(F.col("thread_id").alias(end)), end, "left_anti").select(edges.columns)
    return kept, edges


def merge_fork(base: DataFrame, fork: DataFrame, keys: tuple[str, ...] = EDGE_KEY) -> DataFrame:
    """A fork's edges put back into its base; each key stays as it was first."""
    return insert_missing(base, fork, list(keys))


def closed_pairs(rows: DataFrame) -> DataFrame:
    """Only the rows of tool calls that have exactly one call and one result; others don't go in."""
    both = Window.partitionBy("thread_id", "call_id")
    good = (F.count_if(F.col("kind") == "tool_call").over(both) == 1) & (F.count_if(F.col("kind") == "tool_result").over(both) == 1)
    return rows.withColumn("_good", good).filter("_good").drop("_good")

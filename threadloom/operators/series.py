"""Events of a thread one after the other, each at the price that the one before left behind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from threadloom.sources.scratch import save, scratch


def in_series(events: DataFrame, run: Callable[[DataFrame], DataFrame], prices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All events with ``price`` and ``realised``, and the prices ``thread_id, price`` that threads end with.

    ``events (thread_id, event_id, event_no)`` are taken in rounds: the first of every thread, then
    the second, and so on, so the number of jobs is that of the longest thread. ``run`` gets a
    round's ``(thread_id, event_id, price)`` and returns ``(event_id, price)``, what each event's
    assembly realised; 0 (slack) counts, an event without a row leaves the price as it was.
    ``prices (thread_id, price)`` is what threads start with, 0 where they have none.
    """
    thread = Window.partitionBy("thread_id").orderBy("event_no", "event_id")
    with scratch() as kept:
        rounds = save(events.select("thread_id", "event_id", F.row_number().over(thread).alias("_round")))
        last = rounds.agg(F.max("_round").alias("n")).first()["n"] or 0
        start = rounds.select("thread_id").distinct()
        now = start.join(prices, "thread_id", "full") if prices is not None else start.withColumn("price", F.lit(0.0))
        now = save(now.select("thread_id", F.coalesce("price", F.lit(0.0)).alias("price")))
        done = None
        for number in range(1, last + 1):
            batch = save(rounds.filter(F.col("_round") == number).join(now, "thread_id").select("thread_id", "event_id", "price"))
            told = run(batch).select("event_id", F.col("price").cast("double").alias("realised"))
            after = save(batch.join(told, "event_id", "left"))
            done = after if done is None else done.unionByName(after)
            left = after.select("thread_id", F.coalesce("realised", "price").alias("_now"))
            now = save(now.join(left, "thread_id", "left").select("thread_id", F.coalesce("_now", "price").alias("price")))
        out = save(done if done is not None else rounds.select("thread_id", "event_id").withColumns({"price": F.lit(0.0), "realised": F.lit(None).cast("double")}))
        kept += [out, now]
    return out, now


def in_order(events: DataFrame, step: Callable[[float, dict], float | None], prices: DataFrame | None = None) -> DataFrame:
    """All events ``thread_id, event_id`` with ``price`` and ``realised``, in one pass: for runs that need no job of their own.

    ``events (thread_id, event_id, event_no, ...)``; ``step`` gets the price and an event's row, and
    returns what that realises, or None, which leaves the price as it was. Threads are dealt to
    tasks, sorted, and gone through event by event; only the last price is held, so threads may
    have any length. ``prices (thread_id, price)`` is what threads start with, 0 where they have none.
    """
    kinds = events.schema
    out = StructType([kinds["thread_id"], kinds["event_id"]]).add("price", DoubleType()).add("realised", DoubleType())
    first = events.join(prices.select("thread_id", F.col("price").cast("double").alias("_start")), "thread_id", "left") if prices is not None else events.withColumn("_start", F.lit(0.0))
    dealt = first.withColumn("_start", F.coalesce("_start", F.lit(0.0))).repartition("thread_id").sortWithinPartitions("thread_id", "event_no", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        thread, price = object(), 0.0
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                # a null thread is one thread, whatever pandas makes of null
                now = None if pd.isna(row["thread_id"]) else row["thread_id"]
                if now != thread:
                    thread, price = now, row["_start"]
                realised = step(price, row)
                rows.append((now, row["event_id"], price, realised))
                price = price if realised is None else float(realised)
            made = pd.DataFrame(rows, columns=["thread_id", "event_id", "price", "realised"])
            yield made.astype({"thread_id": "object", "price": float, "realised": float})

    return dealt.mapInPandas(run, out)

"""Structured Streaming forms: pairing, duplicate suppression, running counts, incremental vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.operators import fold
from threadloom.operators.retrieval import coded
from threadloom.operators.series import in_series
from threadloom.operators.telemetry import BAND, RING

LATE = "10 minutes"


def event_time(df: DataFrame, column: str = "ts", late: str = LATE) -> DataFrame:
    """Event time with a watermark; stored times without zone are read in the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """Each (thread, turn, kind, call) once, within the watermark."""
    return blocks.dropDuplicatesWithinWatermark(["thread_id", "turn_id", "kind", "call_id"])


def paired_calls(calls: DataFrame, results: DataFrame, within: str = "1 hour") -> DataFrame:
    """Tool calls with their results; a call that gets none comes out once its time is past.

    Both sides have ``thread_id, call_id, ts`` and a watermark.
    """
    right = results.select(F.col("thread_id").alias("r_thread"), F.col("call_id").alias("r_call"), F.col("ts").alias("result_ts"))
    on = (F.col("thread_id") == F.col("r_thread")) & (F.col("call_id") == F.col("r_call")) & F.expr(f"result_ts between ts and ts + interval {within}")
    return calls.join(right, on, "left_outer").select("thread_id", "call_id", "ts", "result_ts", F.col("result_ts").isNull().alias("is_error"))


def running_citations(selections: DataFrame) -> DataFrame:
    """Selections that hold each message so far; for update or complete mode."""
    return selections.select(F.explode(F.array_distinct("selected")).alias("id")).groupBy("id").agg(F.count("*").alias("n_citations"))


def stage_windows(traces: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Latency by stage and window; rows later than the watermark are left out."""
    return traces.groupBy(F.window("ts", length, slide or length).alias("w"), "stage").agg(F.count("*").alias("n"), F.max("ms").alias("max_ms"))


class _Ring(StatefulProcessor):
    """Keeps a model's last admitted ratios and emits their maximum."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("ratios", "ratio double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.state.get()]
        came = pd.concat(list(rows)).sort_values("seq")
        positive = (came[["predicted", "observed", "budget"]] > 0).all(axis=1)
        came = came[positive & (came["predicted"] * 4 >= came["budget"])]
        ratio = came["observed"] / came["predicted"]
        kept = [*kept, *ratio[ratio.between(*BAND)].astype(float)][-self.size :]
        if kept:
            self.state.put([(x,) for x in kept])
            yield pd.DataFrame({"model": [key[0]], "scale": [max(kept)]})

    def close(self) -> None:
        pass


def token_scales(usage: DataFrame, ring: int = RING) -> DataFrame:
    """The greatest of each model's last admitted ratios, ``usage (model, seq, predicted, observed, budget)``, as state.

    Rows of one micro-batch are taken in the order of ``seq``.
    """
    return usage.groupBy("model").transformWithStateInPandas(_Ring(ring), "model string, scale double", "Update", "none")


class _Turn(StatefulProcessor):
    """Folds a turn's parts as they come; see ``operators.fold`` for the rules."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffers = handle.getValueState("buffers", "said string, thought string, error string, made long, broken boolean")
        self.calls = handle.getMapState("calls", "call_id string", "message_no long, name string, arguments string, signature string, paired boolean")

    def _row(self, key, no: int, kind: str, **fields) -> tuple:
        names = [x.split(" ")[0] for x in fold.MESSAGE.split(", ")][2:]
        return (*key, no, kind, *(fields.get(n, False if n == "is_error" else "") for n in names))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*fold.KEY, *(x.split(" ")[0] for x in fold.MESSAGE.split(", "))])

    def _pair(self, key, call_id: str, call, no: int, text: str, is_error: bool) -> list[tuple]:
        own = {"call_id": call_id, "name": call[1], "arguments": call[2], "signature": call[3]}
        self.calls.updateValue((call_id,), (*call[:4], True))
        return [self._row(key, call[0], "tool_call", **own), self._row(key, no, "tool_result", text=text, call_id=call_id, is_error=is_error)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said, thought, error, made, broken = self.buffers.get() or ("", "", None, 0, False)
        out: list[tuple] = []
        parts = pd.concat(list(rows)).sort_values("seq")
        for part in parts.itertuples():
            text, signature, call_id = ("" if pd.isna(x) else x for x in (part.text, part.signature, part.call_id))
            if broken:
                break
            if part.kind == "tool_call" and not call_id:
                broken = True
            elif part.kind == "text":
                said += text
            elif part.kind == "error":
                error = text
            elif part.kind == "thinking" or (part.kind == "tool_call" and not self.calls.containsKey((call_id,))):
                is_call = part.kind == "tool_call"
                thought += "" if is_call else text
                if thought and (is_call or signature):
                    made += 1
                    out.append(self._row(key, made, "thinking", thinking=thought, signature="" if is_call else signature))
                    thought = ""
                if is_call:
                    made += 1
                    name, arguments = ("" if pd.isna(x) else x for x in (part.name, part.arguments))
                    self.calls.updateValue((call_id,), (made, name, arguments or "{}", signature, False))
            elif part.kind == "tool_result" and self.calls.containsKey((call_id,)):
                call = self.calls.getValue((call_id,))
                if not call[4]:
                    made += 1
                    out += self._pair(key, call_id, call, made, text, False)
        self.buffers.update((said, thought, error, made, broken))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(parts["ts"].max().timestamp() * 1000) + self.quiet_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        said, thought, error, made, broken = self.buffers.get()
        out: list[tuple] = []
        if not broken:
            text = fold.NO_RESULT if error is None else fold.FAILED + error
            for (call_id,), call in sorted(self.calls.iterator(), key=lambda x: x[1][0]):
                if not call[4]:
                    made += 1
                    out += self._pair(key, call_id, call, made, text, True)
            if said or thought:
                out.append(self._row(key, made + 1, "final", text=said, thinking=thought))
        self.buffers.clear()
        self.calls.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def turn_messages(parts: DataFrame, quiet: int = 600) -> DataFrame:
    """Messages of turns as state: ``parts`` as in ``operators.fold``, with event time ``ts`` and a watermark.

    A pair comes out with its result, thinking when it ends; what is open comes out once the
    watermark is ``quiet`` seconds past a turn's last part. Parts of a turn come in the order of
    ``seq``, within a micro-batch in any order.
    """
    schema = f"{fold.KEY[0]} long, {fold.KEY[1]} string, {fold.MESSAGE}"
    return parts.groupBy(*fold.KEY).transformWithStateInPandas(_Turn(quiet * 1000), schema, "Append", "eventTime")


def priced(stream: DataFrame, run: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str):
    """Events ``(thread_id, event_id, event_no)`` in series, micro-batch after micro-batch; see ``operators.series``.

    A micro-batch starts with the prices that the one before it left in ``folder`` and writes its
    own events and prices under its number, so that a batch that is run again changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/prices/batch={batch_id - 1}") if batch_id else None
        events, prices = in_series(batch, run, before)
        events.write.mode("overwrite").parquet(f"{folder}/events/batch={batch_id}")
        prices.write.mode("overwrite").parquet(f"{folder}/prices/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def append_vectors(stream: DataFrame, folder: str, checkpoint: str, model: str):
    """Append the stream's vectors of one model, coded, to the vector table; other models pass by."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = coded(batch.filter(F.col("model_id") == model))
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

"""Telemetry: stage percentiles, the token-scale ring, retries and run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import duration_seconds
from threadloom.sources.scratch import save

RING = 32
BAND = (0.5, 3.0)
MIN_BUDGET_SECONDS = 300


def _ranges(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """``rows`` with ``_range``, ascending with ``value`` within each group: ``n`` about even ranges.

    The cuts of a group are approximate quantiles, one array a group.
    """
    cuts = rows.groupBy(group).agg(F.percentile_approx(value, [k / n for k in range(1, n)], 20 * n).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return rows.join(cuts, group).withColumn("_range", below).drop("_cuts")


def stage_percentiles(traces: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.99), ranges: int = 64) -> DataFrame:
    """Per stage the value at place floor((n - 1) * p) of the sorted values, and the maximum.

    Equal values are one counted row from the start, and these are counted by ranges; only the
    range that holds a wanted place is gone through, so no task sorts all values of a stage, and a
    value that most of a stage has is one row.
    """
    distinct = save(traces.groupBy("stage", "ms").agg(F.count("*").alias("c")))
    rows = _ranges(distinct, "stage", "ms", ranges)
    counts = rows.groupBy("stage", "_range").agg(F.sum("c").alias("c"), F.max("ms").alias("most"))
    upto = Window.partitionBy("stage").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    stage = Window.partitionBy("stage")
    counts = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(stage), "max_ms": F.max("most").over(stage)})
    place = F.explode(F.array(*[F.struct(F.lit(f"p{round(p * 100)}").alias("p"), (F.floor((F.col("n") - 1) * F.lit(p)) + 1).alias("at")) for p in points]))
    wanted = counts.select("stage", "_range", "n", "max_ms", "upto", "c", place.alias("w")).filter("w.at <= upto and w.at > upto - c")
    wanted = wanted.select("stage", "_range", "n", "max_ms", F.col("w.p").alias("p"), (F.col("w.at") - F.col("upto") + F.col("c")).alias("at"))
    held = F.sum("c").over(Window.partitionBy("stage", "_range", "p").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.join(wanted, ["stage", "_range"]).withColumn("held", held).filter("at <= held and at > held - c")
    picks = [F.max(F.when(F.col("p") == f"p{round(p * 100)}", F.col("ms"))).alias(f"p{round(p * 100)}") for p in points]
    return found.groupBy("stage").agg(F.max("n").alias("n"), *picks, F.max("max_ms").alias("max_ms"))


def token_scale(usage: DataFrame, ring: int = RING, ranges: int = 64, block: int = 1 << 16) -> DataFrame:
    """``usage (model, seq, predicted, observed, budget)`` with the scale after each admitted ratio.

    A ratio counts where prediction, observation and budget are positive, the prediction is at
    least a quarter of the budget, and the ratio lies in the band; the scale is the greatest of
    the model's last ``ring`` admitted ratios. Rows are numbered by ranges of ``seq`` and dealt in
    blocks, each with the last ``ring - 1`` rows before it, so that no task orders a whole model.
    """
    rows = usage.filter("predicted > 0 and observed > 0 and budget > 0 and predicted * 4 >= budget")
    rows = rows.withColumn("ratio", F.col("observed") / F.col("predicted")).filter(F.col("ratio").between(*BAND))
    rows = _ranges(rows, "model", "seq", ranges)
    before = Window.partitionBy("model").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("model", "_range").agg(F.count("*").alias("c")).withColumn("_offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    own = F.row_number().over(Window.partitionBy("model", "_range").orderBy("seq"))
    rows = rows.withColumn("_own", own).join(offsets, ["model", "_range"]).withColumn("_no", F.col("_offset") + F.col("_own") - 1)
    at, ahead = F.floor(F.col("_no") / block), F.floor((F.col("_no") + ring - 1) / block)
    dealt = rows.withColumn("_block", F.explode(F.sequence(at, ahead)))
    recent = Window.partitionBy("model", "_block").orderBy("_no").rowsBetween(1 - ring, 0)
    dealt = dealt.withColumn("scale", F.max("ratio").over(recent)).filter(F.col("_block") == at)
    return dealt.select(*usage.columns, "ratio", "scale")


def retries(attempts: DataFrame) -> DataFrame:
    """Stage times add up over attempts; counts are the last attempt's."""
    return attempts.groupBy("run_id").agg(F.sum("ms").alias("ms"), F.max_by("selected_count", "attempt").alias("selected_count"), F.max("attempt").alias("attempts"))


def citations(selections: DataFrame) -> DataFrame:
    """How many selections hold each message; ``selections (event_id, selected array)``."""
    return selections.select("event_id", F.explode(F.array_distinct("selected")).alias("id")).groupBy("id").agg(F.count("*").alias("n_citations"))


def remaining(limit: Column, elapsed_seconds: Column) -> tuple[Column, Column]:
    """What is left of a run's time limit (a duration such as ``2h30m``), at least five minutes, and why there is none."""
    total = duration_seconds(limit)
    reason = (
        F.when(F.coalesce(limit, F.lit("")) == "", "no duration_limit")
        .when(elapsed_seconds.isNull(), "no started_at")
        .when(total.isNull(), F.concat(F.lit("unparseable duration_limit="), limit))
        .when(total <= 0, F.concat(F.lit("non-positive duration_limit="), limit))
        .when(total - elapsed_seconds <= 0, "budget expired")
    )
    return F.when(reason.isNull(), F.greatest(total - elapsed_seconds, F.lit(float(MIN_BUDGET_SECONDS)))), reason


def reconcile(states: DataFrame) -> DataFrame:
    """What happens at start to ``states (thread_id, status, mode, duration_limit, elapsed_seconds)`` that are not idle."""
    left, reason = remaining(F.col("duration_limit"), F.col("elapsed_seconds"))
    why = F.when(F.col("mode") != "autonomous", "non-autonomous").when(F.col("status") == "paused", "paused").otherwise(reason)
    rows = states.filter("status <> 'idle'").withColumn("reason", why)
    return rows.withColumns({"action": F.when(F.col("reason").isNull(), "resume").otherwise("idle"), "left_seconds": F.when(F.col("reason").isNull(), left)})


def ranking_summary(ranks: DataFrame, points: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall at each depth by category, and over all (null category)."""
    cells = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in points]
    return ranks.rollup("category").agg(F.count("*").alias("n"), *cells)


def first_hits(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """The rank of each query's best hit: one more than the rows before it, by counting alone.

    ``rows (query_id, vec_id, score)``: all rows of all queries; ``hits``: those that count.
    """
    best = hits.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("less"))).alias("b"))
    best = best.select("query_id", F.col("b.score").alias("top"), (-F.col("b.less")).alias("top_id"))
    ahead = (F.col("score") > F.col("top")) | ((F.col("score") == F.col("top")) & (F.col("vec_id") < F.col("top_id")))
    counted = rows.join(best, "query_id", "left").groupBy("query_id").agg(F.count_if(ahead).alias("n"), F.first("top").alias("top"))
    return counted.select("query_id", F.when(F.col("top").isNotNull(), F.col("n") + 1).alias("rank"))


def stage_times(runs: DataFrame) -> DataFrame:
    """``runs (started, first_at, ended, assembly_ms)`` with the wait for the model and the time of its stream.

    The wait lasts to the first event, less the assembly, at least 0; a run without events has waited all along.
    """
    ms = lambda a, b: F.unix_millis(F.col(b).cast("timestamp")) - F.unix_millis(F.col(a).cast("timestamp"))
    waited = F.when(F.col("first_at").isNull(), ms("started", "ended")).otherwise(F.greatest(ms("started", "first_at") - F.col("assembly_ms"), F.lit(0)))
    return runs.withColumns({"complete_ms": waited, "stream_ms": F.coalesce(ms("first_at", "ended"), F.lit(0).cast("long"))})

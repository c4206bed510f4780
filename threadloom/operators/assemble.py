"""Budgeted delivery: diversity, trimming, shedding and chat messages.

Diversity, where every choice depends on the last one, runs per event in pandas; an event's rows are
the selected messages, which the graph walk's cap bounds. The rest are joins, windows and running
sums. Only ``canonical`` and ``wire`` take an event's messages into one window: they are what is
sent, so a model's context bounds them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import stats as S
from threadloom.operators import threads
from threadloom.operators.running import suffix_sums
from threadloom.sources.scratch import save, scratch


def _similarity(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return min(max(float(a @ b) / size, 0.0), 1.0) if size else 0.0


def diversify(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy order of one event: the best of score * (1 - closeness to what is kept or to the nearest that is asked)."""
    rows = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    vectors = [None if v is None else np.asarray(v, float) for v in rows["vector"]]
    asked = [np.asarray(v, float) for v in next((x for x in rows["query_vectors"] if x is not None), []) if v is not None]
    if all(v is None for v in vectors):
        return rows.assign(place=range(1, len(rows) + 1), effective=rows["score"])[["event_id", "id", "place", "effective"]]
    near = np.array([max((_similarity(v, q) for q in asked), default=0.0) for v in vectors])
    left, order = list(range(len(rows))), []
    while left:
        gains = [rows["score"][k] * (1 - near[k]) for k in left]
        pick = left[int(np.argmax(gains))]
        order.append((pick, max(gains)))
        left.remove(pick)
        for k in left:
            near[k] = max(near[k], _similarity(vectors[k], vectors[pick]))
    at = [k for k, _ in order]
    return pd.DataFrame({"event_id": rows["event_id"][at].values, "id": rows["id"][at].values, "place": range(1, len(at) + 1), "effective": [g for _, g in order]})


def mmr(selected: DataFrame) -> DataFrame:
    """``selected (event_id, id, score, vector)`` in greedy order of novelty.

    ``query_vectors`` has the vectors of all messages that ask (``query_vector`` where there is
    one): what echoes any of them is discounted.
    """
    asked = F.col("query_vectors") if "query_vectors" in selected.columns else F.when(F.col("query_vector").isNotNull(), F.array("query_vector"))
    rows = selected.select(F.col("event_id").cast("long"), F.col("id").cast("string"), F.col("score").cast("double"), "vector", asked.alias("query_vectors"))
    return rows.groupBy("event_id").applyInPandas(lambda p: diversify(p), "event_id long, id string, place int, effective double")


def merge_groups(groups: DataFrame) -> DataFrame:
    """Delivery groups ``(event_id, root_id, score, members)`` with the same members become one."""
    rows = groups.withColumn("key", F.array_sort(F.array_distinct("members")))
    merged = rows.groupBy("event_id", "key").agg(F.sort_array(F.collect_set("root_id")).alias("root_ids"), F.max("score").alias("score"))
    return merged.withColumnRenamed("key", "members")


def density_shed(groups: DataFrame, stance: float = 1.0) -> DataFrame:
    """``groups (event_id, group_id, score, members, costs, budget)`` with ``kept`` and the event's price.

    The least dense groups go until the rest fits. A group's density, bits beyond the stance for
    each token of the group alone, does not change while others go, so what stays is always the end
    of one order; a member that groups share is paid for by the last of them in that order, and
    running sums tell where the rest fits. Optional columns: ``fixed``, tokens that are sent in any
    case (system text, local messages, tools), and ``position``, by which ties are broken, then by
    ``group_id``. ``price`` is the greatest density that went, ``tokens`` what is left to send;
    ``too_large`` says that even the fixed part exceeds the budget. No limit where the budget is not
    positive. A member has one cost in an event.
    """
    for name in ("fixed", "position"):
        groups = groups if name in groups.columns else groups.withColumn(name, F.lit(0))
    rows = groups.select("event_id", F.col("group_id").cast("string").alias("group_id"), F.col("score").cast("double").alias("score"), "members", "costs", *[F.col(c).cast("long").alias(c) for c in ("budget", "fixed", "position")])
    alone = F.aggregate("costs", F.lit(0).cast("long"), lambda t, c: t + c)
    order = ["density", "position", "group_id"]
    with scratch() as kept:
        rows = save(rows.withColumn("density", (S.bits_of_confidence(F.col("score")) - stance) / F.greatest(alone, F.lit(1))))
        each = rows.select("event_id", F.struct(*order).alias("at"), F.explode(F.arrays_zip("members", "costs")).alias("m"))
        last = each.groupBy("event_id", "m.members").agg(F.max(F.struct("at", "m.costs")).alias("last"))
        paid = last.groupBy("event_id", "last.at").agg(F.sum("last.costs").alias("paid")).select("event_id", "at.*", "paid")
        listed = rows.select("event_id", *order, "budget", "fixed")
        sums = suffix_sums(listed.join(paid, ["event_id", *order], "left"), "event_id", order, "paid", "sent")
        sums = save(sums.withColumn("kept", (F.col("budget") <= 0) | (F.col("fixed") + F.col("sent") <= F.col("budget"))))
        gone = F.when(~F.col("kept"), F.greatest("density", F.lit(0.0)))
        event = sums.groupBy("event_id").agg(F.coalesce(F.max(gone), F.lit(0.0)).alias("price"), (F.max("fixed") + F.coalesce(F.max(F.when(F.col("kept"), F.col("sent"))), F.lit(0))).cast("long").alias("tokens"), F.max("budget").alias("_budget"))
        out = sums.select("event_id", "group_id", "kept").join(event, "event_id")
        out = save(out.select("event_id", "group_id", "kept", "price", "tokens", ((F.col("_budget") > 0) & (F.col("tokens") > F.col("_budget"))).alias("too_large")))
        kept.append(out)
    return out


def trim_oldest(window: DataFrame) -> DataFrame:
    """``window (event_id, id, position, tokens, pinned, budget)``: the oldest unpinned go until it fits.

    A row stays where it, all pinned rows and all newer rows fit; one window, no loop.
    """
    event = Window.partitionBy("event_id")
    pinned = F.sum(F.when(F.col("pinned"), F.col("tokens")).otherwise(0)).over(event)
    newer = F.sum(F.when(F.col("pinned"), 0).otherwise(F.col("tokens"))).over(event.orderBy(F.desc("position"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("pinned") | (F.col("budget") <= 0) | (pinned + newer <= F.col("budget"))
    return window.withColumn("kept", fits)


def pins(window: DataFrame) -> DataFrame:
    """The anchor and the last user and assistant rows that say something are pinned.

    ``window (event_id, position, role, ...)``, with ``meaningful`` and ``turn_current`` where rows
    may say nothing or belong to earlier turns; the anchor is the last meaningful row of the
    current turn.
    """
    says = F.coalesce("meaningful", F.lit(False)) if "meaningful" in window.columns else F.lit(True)
    now = F.coalesce("turn_current", F.lit(False)) if "turn_current" in window.columns else F.lit(True)
    event = Window.partitionBy("event_id")
    anchor = F.max(F.when(says & now, F.col("position"))).over(event)
    of_role = F.max(F.when(says, F.col("position"))).over(Window.partitionBy("event_id", "role"))
    own = F.col("role").isin("user", "assistant") & (F.col("position") == of_role)
    return window.withColumn("pinned", F.coalesce(F.col("position") == anchor, F.lit(False)) | F.coalesce(own, F.lit(False)))


def wire(selected: DataFrame, local: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """What is sent: selected and local messages once each, less what was ``delivered (event_id, id)``.

    ``wire_no`` numbers them by thread, position and id.
    """
    rows = selected.unionByName(local).dropDuplicates(["event_id", "id"])
    if delivered is not None:
        rows = rows.join(delivered.select("event_id", "id"), ["event_id", "id"], "left_anti")
    order = Window.partitionBy("event_id").orderBy("thread_id", "position", "id")
    return rows.withColumn("wire_no", F.row_number().over(order))


def overlapping(groups: DataFrame, local: DataFrame) -> DataFrame:
    """Delivery groups without those that share a member with the event's ``local (event_id, id)``."""
    own = local.groupBy("event_id").agg(F.collect_set("id").alias("_own"))
    rows = groups.join(own, "event_id", "left")
    return rows.filter(F.col("_own").isNull() | ~F.arrays_overlap("members", "_own")).drop("_own")


def closure_count(groups: DataFrame) -> DataFrame:
    """How many messages each event gets for the sake of others: members beyond the root."""
    return groups.groupBy("event_id").agg(F.sum(F.size("members") - 1).alias("n_closure"))


def lowest_surviving(selected: DataFrame, excluded: DataFrame) -> DataFrame:
    """The selected message of the lowest score that is not excluded yet: what an overflow drops next."""
    left = selected.join(excluded.select("event_id", "id"), ["event_id", "id"], "left_anti")
    return left.groupBy("event_id").agg(F.min_by("id", F.struct("score", "id")).alias("id"), F.min("score").alias("score"))


def wire_tokens(messages: DataFrame, delimiter: int = 0, fixed: int = 0) -> DataFrame:
    """Tokens of each event's messages with a delimiter for each and a fixed part."""
    return messages.groupBy("event_id").agg((F.sum(F.col("tokens") + delimiter) + fixed).alias("total"))


def assemble(selected: DataFrame, local: DataFrame, messages: DataFrame, blocks: DataFrame, budgets: DataFrame, delimiter: int = 0, loss_ratio: float = 0.5, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What is sent to the model for each event, and what that cost.

    ``selected (event_id, id, score)``; ``local (event_id, id)``, the turn and the one before it;
    ``messages (id, thread_id, position, tokens)``; ``blocks`` as in ``closed_groups``; ``budgets
    (event_id, budget, fixed)``, no limit where the budget is not positive. ``excluded (event_id,
    id)`` are shed from the start: a retry after an overflow passes the same selection with them
    and selects nothing anew.

    Selected messages come with all that protocol binds to them; groups with the same members are
    one, those that touch local messages are sent anyway and go. The least dense groups are shed
    until the rest fits. Wire: ``event_id, wire_no, id, source`` (``selected`` before ``local``).
    Report: ``event_id, n_selected, n_closure, n_shed, tokens, price, outcome``; the outcome is
    ``ok``, ``local too large``, the problem of a group (``missing``, ``ambiguous``) or ``missing
    content`` (a selected, local or bound id without a message), all of which leave the event
    without wire.
    """
    stance = -math.log2(1 - loss_ratio)
    with scratch() as kept:
        facts = save(messages.select("id", "thread_id", "position", (F.col("tokens") + delimiter).alias("cost")))
        own = save(threads.closed_groups(local.select("event_id", F.col("id").alias("root_id"), F.lit(1.0).alias("score")), blocks))
        sent = save(own.select("event_id", F.explode("members").alias("id")).distinct())
        roots = selected.select("event_id", F.col("id").alias("root_id"), "score").join(sent.withColumnRenamed("id", "root_id"), ["event_id", "root_id"], "left_anti")
        if excluded is not None:
            roots = roots.join(excluded.select("event_id", F.col("id").alias("root_id")), ["event_id", "root_id"], "left_anti")
        closed = save(threads.closed_groups(roots, blocks))
        groups = save(merge_groups(overlapping(closed, sent)))
        costed = groups.withColumn("id", F.explode("members")).join(facts, "id")
        costed = costed.groupBy("event_id", "members", "root_ids", "score").agg(F.sort_array(F.collect_list(F.struct("id", "cost"))).alias("c"), F.min("position").alias("position"))
        local_cost = sent.join(facts, "id").groupBy("event_id").agg(F.sum("cost").alias("local_cost"))
        limits = budgets.join(local_cost, "event_id", "left").select("event_id", "budget", (F.col("fixed") + F.coalesce("local_cost", F.lit(0))).alias("fixed"))
        ready = costed.join(limits, "event_id").select("event_id", F.array_join("root_ids", ",").alias("group_id"), "root_ids", "members", "score", F.transform("c", lambda x: x["cost"]).alias("costs"), F.transform("c", lambda x: x["id"]).alias("of"), "budget", "fixed", "position")
        ready = save(ready.drop("members").withColumnRenamed("of", "members"))
        shed_rows = save(density_shed(ready, stance))
        bound = closed.unionByName(own)
        absent = bound.select("event_id", F.explode("members").alias("id")).join(facts.select("id"), "id", "left_anti")
        found = bound.select("event_id", "problem").unionByName(absent.select("event_id", F.lit("missing content").alias("problem")))
        problems = found.groupBy("event_id").agg(F.min("problem").alias("problem"))
        left = ready.join(shed_rows.filter("kept").select("event_id", "group_id"), ["event_id", "group_id"])
        counts = left.groupBy("event_id").agg(F.count("*").alias("n_selected"), F.sum(F.size("members") - 1).alias("n_closure"))
        dropped = ready.join(shed_rows.filter("not kept").select("event_id", "group_id"), ["event_id", "group_id"]).groupBy("event_id").agg(F.sum(F.size("root_ids")).alias("n_shed"))
        sums = shed_rows.groupBy("event_id").agg(F.max("price").alias("price"), F.max("tokens").alias("tokens"), F.max("too_large").alias("too_large"))
        local_closure = own.groupBy("event_id").agg(F.sum(F.size("members") - 1).alias("local_closure"))
        report = limits.join(counts, "event_id", "left").join(dropped, "event_id", "left").join(sums, "event_id", "left").join(problems, "event_id", "left").join(local_closure, "event_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        tokens = F.coalesce("tokens", "fixed").cast("long")
        outcome = F.when(F.col("problem").isNotNull(), F.col("problem")).when((F.col("budget") > 0) & (tokens > F.col("budget")), "local too large").otherwise("ok")
        report = report.select("event_id", zero("n_selected").alias("n_selected"), (zero("n_closure") + zero("local_closure")).alias("n_closure"), zero("n_shed").alias("n_shed"), tokens.alias("tokens"), F.coalesce("price", F.lit(0.0)).alias("price"), outcome.alias("outcome"))
        report = save(report)
        fine = report.filter("outcome = 'ok'").select("event_id")
        chosen = left.select("event_id", F.explode("members").alias("id"), F.lit("selected").alias("source"))
        rows = chosen.join(sent, ["event_id", "id"], "left_anti").unionByName(sent.withColumn("source", F.lit("local")))
        rows = rows.dropDuplicates(["event_id", "id"]).join(fine, "event_id").join(facts, "id")
        order = Window.partitionBy("event_id").orderBy(F.desc("source"), "thread_id", "position", "id")
        out = save(rows.select("event_id", F.row_number().over(order).alias("wire_no"), "id", "source"))
        kept += [out, report]
    return out, report


def canonical(wire_blocks: DataFrame) -> DataFrame:
    """Chat messages from ``wire_blocks (event_id, wire_no, block_no, role, kind, text, call_id)``.

    A message says its texts first, then makes its calls, then gives its results. Calls without
    result and results without call before them go; neighbouring calls are one message and their
    results follow it; thinking goes along with the next text or calls, and goes where none follow.
    Returns ``event_id, message_no, role, text, thinking, call_ids, call_id, calls``; ``calls`` has
    id, name and arguments, null where ``wire_blocks`` lacks them. A null text is empty.
    """
    for name in ("name", "arguments"):
        wire_blocks = wire_blocks if name in wire_blocks.columns else wire_blocks.withColumn(name, F.lit(None).cast("string"))
    blocks = wire_blocks.withColumn("text", F.coalesce("text", F.lit("")))
    place = F.struct("wire_no", "stage", "block_no")

    def joined(kind: str):
        texts = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("block_no", "text"))))
        return F.array_join(F.transform(texts, lambda x: x["text"]), "\n")

    said = blocks.filter(F.col("kind").isin("text", "thinking")).groupBy("event_id", "wire_no").agg(F.min_by("role", "block_no").alias("role"), joined("text").alias("text"), joined("thinking").alias("thinking"))
    nothing = F.lit(None).cast("string")
    said = said.select("event_id", "wire_no", F.lit(0).alias("stage"), F.lit(0).alias("block_no"), "role", "text", "thinking", nothing.alias("call_id"), nothing.alias("name"), nothing.alias("arguments"))
    of = lambda kind, stage: blocks.filter(F.col("kind") == kind).select("event_id", "wire_no", F.lit(stage).alias("stage"), "block_no", "role", "text", F.lit("").alias("thinking"), "call_id", "name", "arguments")
    event = Window.partitionBy("event_id").orderBy("wire_no", "stage", "block_no")
    atoms = said.unionByName(of("tool_call", 1)).unionByName(of("tool_result", 2))
    opens = (F.col("stage") == 1) & (F.coalesce(F.lag("stage").over(event), F.lit(0)) != 1)
    atoms = atoms.withColumn("speaks", opens | ((F.col("stage") == 0) & (F.col("text") != "")))
    with scratch() as kept:
        # a turn is a text or a run of calls; what is only thought belongs to the next one
        atoms = save(atoms.withColumn("turn", F.sum(F.col("speaks").cast("int")).over(event.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", place))
        thoughts = atoms.filter("thinking <> ''").groupBy("event_id", (F.col("turn") + F.when(F.col("speaks"), 0).otherwise(1)).alias("turn"))
        thoughts = thoughts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "thinking"))), lambda x: x["thinking"]), "\n").alias("thinking"))
        calls, results = atoms.filter("stage = 1"), atoms.filter("stage = 2")
        answered = calls.join(results.select("event_id", "call_id").distinct(), ["event_id", "call_id"], "left_semi")
        none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
        texts = atoms.filter("stage = 0 and text <> ''").select("event_id", "turn", F.lit(0).alias("part"), "place", "role", "text", nothing.alias("call_id"), none.alias("calls"))
        made = F.transform(F.sort_array(F.collect_list(F.struct("place", F.struct(F.col("call_id").alias("id"), "name", "arguments").alias("call")))), lambda x: x["call"])
        runs = answered.groupBy("event_id", "turn").agg(F.min("place").alias("place"), made.alias("calls")).select("event_id", "turn", F.lit(0).alias("part"), "place", F.lit("assistant").alias("role"), F.lit("").alias("text"), nothing.alias("call_id"), "calls")
        first = calls.groupBy("event_id", "call_id", "turn").agg(F.min("place").alias("asked"))
        given = results.drop("turn").join(first, ["event_id", "call_id"]).filter("asked < place").groupBy("event_id", "place", "text", "call_id").agg(F.min("turn").alias("turn"))
        given = given.select("event_id", "turn", F.lit(1).alias("part"), "place", F.lit("tool").alias("role"), "text", "call_id", none.alias("calls"))
        rows = texts.unionByName(runs).unionByName(given).join(thoughts, ["event_id", "turn"], "left")
        number = F.row_number().over(Window.partitionBy("event_id").orderBy("turn", "part", "place")) - 1
        thinking = F.when(F.col("part") == 0, F.coalesce("thinking", F.lit(""))).otherwise("")
        out = save(rows.select("event_id", number.alias("message_no"), "role", "text", thinking.alias("thinking"), F.transform("calls", lambda c: c["id"]).alias("call_ids"), "call_id", "calls"))
        kept.append(out)
    return out

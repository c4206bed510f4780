"""Messages of a turn from the stream of parts that a model's run emits.

``parts (thread_id, turn_id, seq, kind, text, signature, call_id, name, arguments)``: kinds are
``text``, ``thinking``, ``tool_call``, ``tool_result`` and ``error``; ``seq`` orders a turn's parts
and tells them apart. A turn is one reply of a model, so its parts fit in a task.

Rules. A call counts once, where it first comes, and comes out only together with a result: the
first one after it, or an error result at the end of the turn. Results without a call before them
go. Thinking gathers until a new call comes, until a part brings a signature (which covers exactly
what is gathered then, and is dropped where nothing is), or until the turn ends. Texts gather until
the turn ends and are the last message, with what was thought since. A call without id ends its
turn there: no last message, and calls still open go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["thread_id", "turn_id"]
#: What an error result says, alone and before the run's last error.
NO_RESULT, FAILED = "Tool execution ended without a result.", "Tool execution failed: "
MESSAGE = "message_no long, kind string, text string, thinking string, signature string, call_id string, name string, arguments string, is_error boolean"


def _in_order(value: Column, *order: str) -> Column:
    """Texts of a group joined in their order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]), "")


def _parts(parts: DataFrame) -> DataFrame:
    """Parts before a turn's first call without id, with ``new`` (a call that counts), ``closes`` (thinking ends here) and ``group``."""
    turn = Window.partitionBy(*KEY)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = parts.select(*KEY, "seq", "kind", *[text(c).alias(c) for c in ("text", "signature", "call_id", "name", "arguments")])
    call = F.col("kind") == "tool_call"
    rows = rows.withColumn("bad", F.min(F.when(call & (F.col("call_id") == ""), F.col("seq"))).over(turn)).filter(F.col("bad").isNull() | (F.col("seq") <= F.col("bad")))
    first = F.row_number().over(Window.partitionBy(*KEY, "kind", "call_id").orderBy("seq")) == 1
    rows = rows.withColumn("new", call & first & (F.col("call_id") != ""))
    rows = rows.withColumn("closes", F.col("new") | ((F.col("kind") == "thinking") & (F.col("signature") != "")))
    before = F.coalesce(F.sum(F.col("closes").cast("int")).over(turn.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("group", before)


def fold(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages ``thread_id, turn_id, message_no, kind, text, ...`` and a report ``thread_id, turn_id, outcome``.

    Kinds are ``thinking``, ``tool_call``, ``tool_result`` and ``final`` (text, and thinking that no
    call or signature ended). ``message_no`` counts from 1 in the order in which messages come into
    being; a call that goes for want of a pair leaves a gap. Outcomes: ``message``, ``call without
    id``, ``error: <the last one>`` or ``no response``. A null text or name is empty, missing
    arguments are ``{}``.
    """
    rows = _parts(parts)
    nothing = F.lit("")
    turns = rows.groupBy(*KEY).agg(
        F.max(F.col("bad").isNotNull()).alias("broken"),
        F.max_by(F.when(F.col("kind") == "error", F.col("text")), F.when(F.col("kind") == "error", F.col("seq"))).alias("error"),
        _in_order(F.when(F.col("kind") == "text", F.col("text")), "seq").alias("said"),
    )
    row = lambda **c: [c.get(n, F.lit(False) if n == "is_error" else nothing).alias(n) for n in ("kind", "text", "thinking", "signature", "call_id", "name", "arguments", "is_error")]
    place = lambda late, seq, sub: [F.lit(late).alias("late"), seq.alias("seq"), F.lit(sub).alias("sub")]

    thought = rows.filter("kind = 'thinking'").groupBy(*KEY, "group").agg(_in_order(F.col("text"), "seq").alias("thinking")).filter("thinking <> ''")
    ends = rows.filter("closes").select(*KEY, "group", "seq", F.when(F.col("kind") == "thinking", F.col("signature")).otherwise("").alias("signature"))
    thought = thought.join(ends, [*KEY, "group"], "left")
    thinking = thought.filter("seq is not null").select(*KEY, *place(0, F.col("seq"), 0), *row(kind=F.lit("thinking"), thinking=F.col("thinking"), signature=F.col("signature")))
    trailing = thought.filter("seq is null").select(*KEY, "thinking")

    calls = rows.filter("new").select(*KEY, "seq", "call_id", "name", F.when(F.col("arguments") == "", "{}").otherwise(F.col("arguments")).alias("arguments"), "signature")
    came = rows.filter("kind = 'tool_result'").select(*KEY, "call_id", F.col("seq").alias("at"), "text")
    paired = calls.join(came, [*KEY, "call_id"], "left").withColumn("after", F.when(F.col("at") > F.col("seq"), F.col("at")))
    paired = paired.groupBy(*KEY, "call_id", "seq", "name", "arguments", "signature").agg(F.min(F.when(F.col("after").isNotNull(), F.struct("after", "text"))).alias("r"))
    paired = paired.join(turns.select(*KEY, "broken", "error"), KEY)
    made = paired.select(*KEY, *place(0, F.col("seq"), 1), *row(kind=F.lit("tool_call"), signature=F.col("signature"), call_id=F.col("call_id"), name=F.col("name"), arguments=F.col("arguments")), (F.col("broken") & F.col("r").isNull()).alias("open"))
    given = paired.filter("r is not null").select(*KEY, *place(0, F.col("r.after"), 2), *row(kind=F.lit("tool_result"), text=F.col("r.text"), call_id=F.col("call_id")))
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit(FAILED), "error")).otherwise(NO_RESULT)
    lacking = paired.filter("r is null and not broken").select(*KEY, *place(1, F.col("seq"), 0), *row(kind=F.lit("tool_result"), text=failed, call_id=F.col("call_id"), is_error=F.lit(True)))
    final = turns.filter("not broken").join(trailing, KEY, "left").withColumn("thinking", F.coalesce("thinking", nothing)).filter("said <> '' or thinking <> ''")
    final = final.select(*KEY, *place(2, F.lit(0).cast("long"), 0), *row(kind=F.lit("final"), text=F.col("said"), thinking=F.col("thinking")))

    closed = F.lit(False).alias("open")
    every = made
    for more in (thinking, given, lacking, final):
        every = every.unionByName(more.withColumn("open", closed))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("late", "seq", "sub")).cast("long")
    messages = every.withColumn("message_no", number).filter(~F.col("open")).drop("late", "seq", "sub", "open")
    outcome = F.when(F.col("broken"), "call without id").when(F.col("final"), "message").when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise("no response")
    report = turns.join(final.select(*KEY, F.lit(True).alias("final")), KEY, "left").withColumn("final", F.coalesce("final", F.lit(False)))
    return messages.select(*KEY, "message_no", "kind", "text", "thinking", "signature", "call_id", "name", "arguments", "is_error"), report.select(*KEY, outcome.alias("outcome"))

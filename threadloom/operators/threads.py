"""Windows, joins and aggregates over the messages of threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.scratch import save, scratch


def _thread():
    return Window.partitionBy("thread_id")


def _newest():
    return _thread().orderBy(F.desc("position"), "id")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of every thread."""
    return messages.withColumn("_k", F.row_number().over(_newest())).filter(F.col("_k") <= n).drop("_k")


def latest(messages: DataFrame) -> DataFrame:
    """Each thread's newest message, by one aggregation; the smallest id of those at one position, as in ``recent``."""
    rest = [c for c in messages.columns if c != "thread_id"]
    newest = F.struct((-F.col("position")).alias("_back"), F.col("id").alias("_id"))
    top = messages.filter("position is not null").groupBy("thread_id").agg(F.min_by(F.struct(*rest), newest).alias("m"))
    return top.select("thread_id", *[F.col(f"m.{c}").alias(c) for c in rest])


def page(messages: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Messages in thread order; without a positive limit all of them, whatever the offset."""
    ordered = messages.orderBy("thread_id", "position", "id")
    return ordered.offset(offset).limit(limit) if limit > 0 else ordered


def counts(messages: DataFrame) -> DataFrame:
    """Messages of every thread and its highest position."""
    return messages.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.coalesce(F.max("position"), F.lit(-1)).alias("max_position"))


def turn_start(messages: DataFrame) -> DataFrame:
    """``start_position``: where the message's turn begins; its own position outside of turns."""
    first = F.min("position").over(Window.partitionBy("thread_id", "turn_id"))
    return messages.withColumn("start_position", F.when(F.col("turn_id") != "", first).otherwise(F.col("position")))


def preceding_turn(messages: DataFrame) -> DataFrame:
    """Every turn of a thread with the turn before it (null for the first)."""
    turns = messages.filter("turn_id <> ''").groupBy("thread_id", "turn_id").agg(F.max("position").alias("last_position"))
    return turns.withColumn("previous_turn", F.lag("turn_id").over(_thread().orderBy("last_position")))


def discourse(messages: DataFrame, n: int) -> DataFrame:
    """Each thread from the start of its current turn; its last ``n`` messages where there is no turn."""
    current = F.max(F.struct("position", "turn_id")).over(_thread())["turn_id"]
    rows = messages.withColumns({"_turn": current, "_k": F.row_number().over(_newest())})
    start = F.min(F.when(F.col("turn_id") == F.col("_turn"), F.col("position"))).over(_thread())
    rows = rows.withColumn("_start", start)
    kept = F.when(F.col("_turn") != "", F.col("position") >= F.col("_start")).otherwise(F.col("_k") <= n)
    return rows.filter(kept).drop("_turn", "_k", "_start")


def in_flight(messages: DataFrame) -> DataFrame:
    """The current and the preceding turn of every thread."""
    turns = preceding_turn(messages)
    top = turns.groupBy("thread_id").agg(F.max(F.struct("last_position", "turn_id", "previous_turn")).alias("t"))
    wanted = top.select("thread_id", F.explode(F.array("t.turn_id", "t.previous_turn")).alias("turn_id")).filter("turn_id is not null")
    return messages.join(wanted, ["thread_id", "turn_id"], "left_semi").select(messages.columns)


def turn_peers(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """All messages that share a turn with one of ``ids (id)``."""
    turns = messages.join(ids.select("id"), "id", "left_semi").filter("turn_id <> ''").select("thread_id", "turn_id").distinct()
    return messages.join(turns, ["thread_id", "turn_id"], "left_semi").select(messages.columns)


def branch_corpus(messages: DataFrame, branches: DataFrame) -> DataFrame:
    """What each of ``branches (thread_id, parent_id, branch_position)`` sees: its parent before the branch, then itself."""
    own = messages.join(branches.select("thread_id"), "thread_id", "left_semi").withColumn("branch_id", F.col("thread_id"))
    parents = branches.select(F.col("thread_id").alias("branch_id"), F.col("parent_id").alias("thread_id"), "branch_position")
    before = messages.join(parents, "thread_id").filter("position < branch_position").drop("branch_position")
    return before.select("branch_id", *messages.columns).unionByName(own.select("branch_id", *messages.columns))


def next_positions(messages: DataFrame, arriving: DataFrame) -> DataFrame:
    """``arriving`` (thread_id, seq) placed after what is stored, in the order of seq."""
    known = messages.groupBy("thread_id").agg(F.max("position").alias("_last"))
    rows = arriving.join(known, "thread_id", "left")
    step = F.row_number().over(_thread().orderBy("seq"))
    return rows.withColumn("position", F.coalesce("_last", F.lit(-1)) + step).drop("_last")


def tool_pairs(blocks: DataFrame) -> DataFrame:
    """Tool calls with their results by ``(thread_id, call_id)``; ``problem`` says what is wrong.

    ``blocks (thread_id, message_id, kind, call_id)``. One aggregation, whatever the number of
    blocks that share a key.
    """
    call, result = F.col("kind") == "tool_call", F.col("kind") == "tool_result"
    sums = blocks.filter(call | result).groupBy("thread_id", "call_id").agg(
        F.count_if(call).alias("n_calls"),
        F.count_if(result).alias("n_results"),
        F.min(F.when(call, F.col("message_id"))).alias("call_message"),
        F.min(F.when(result, F.col("message_id"))).alias("result_message"),
    )
    problem = F.when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "ambiguous").when((F.col("n_calls") == 0) | (F.col("n_results") == 0), "missing")
    return sums.withColumn("problem", problem)


def recent_activity(messages: DataFrame, limit: int, most_bytes: int = 80) -> DataFrame:
    """The ``limit`` threads that were active last, with their newest message cut to ``most_bytes`` bytes."""
    rows = latest(messages).withColumn("summary", F.substring(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 1, most_bytes).cast("string"))
    return rows.orderBy(F.desc("created_at"), "thread_id").limit(limit).select("thread_id", "id", "created_at", "summary")


def listed(threads: DataFrame, folders: DataFrame, archived: bool = False) -> DataFrame:
    """Threads, newest first, with the sorted list of their ``folders (thread_id, path)``."""
    kept = threads if archived else threads.filter(~F.coalesce("archived", F.lit(False)))
    paths = folders.groupBy("thread_id").agg(F.sort_array(F.collect_set("path")).alias("folders"))
    rows = kept.join(paths, "thread_id", "left").withColumn("folders", F.coalesce("folders", F.array().cast("array<string>")))
    return rows.orderBy(F.desc("created_at"), "thread_id")


def chunks_of(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Each wanted message's chunks in order, as one list; a message without chunks has an empty one."""
    rows = chunks.join(ids.select(F.col("id").alias("message_id")).distinct(), "message_id", "left_semi")
    lists = rows.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("chunks"))
    asked = ids.select(F.col("id").alias("message_id")).distinct()
    return asked.join(lists, "message_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<chunk_index:int,text:string>>")))


def closed_groups(roots: DataFrame, blocks: DataFrame) -> DataFrame:
    """What must be sent together with each root: calls with their results, transitively.

    ``roots (event_id, root_id, score)``; ``blocks (message_id, thread_id, kind, call_id)``. Returns
    ``event_id, root_id, score, members, problem``: ``members`` are sorted ids, the root among
    them; ``problem`` is ``missing`` or ``ambiguous`` where a counterpart is not exactly one message.
    """
    blocks = blocks.filter(F.col("kind").isin("tool_call", "tool_result") & (F.coalesce("call_id", F.lit("")) != "")).select("message_id", "thread_id", "kind", "call_id").distinct()
    ends = blocks.groupBy("thread_id", "call_id", "kind").agg(F.count("*").alias("n"), F.min("message_id").alias("other"))
    ends = ends.withColumn("kind", F.when(F.col("kind") == "tool_call", "tool_result").otherwise("tool_call"))
    links = blocks.join(ends, ["thread_id", "call_id", "kind"], "left")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
    with scratch() as kept:
        links = save(links.select(F.col("message_id").alias("id"), "other", problem.alias("problem")))
        members = fresh = save(roots.select("event_id", "root_id", F.col("root_id").alias("id")).distinct())
        tables = [members]
        while not fresh.isEmpty():
            onward = fresh.join(links.filter("problem is null"), "id").select("event_id", "root_id", F.col("other").alias("id")).distinct()
            fresh = save(onward.join(members, ["event_id", "root_id", "id"], "left_anti"))
            tables.append(fresh)
            members = members.unionByName(fresh)
        bad = members.join(links.filter("problem is not null"), "id").groupBy("event_id", "root_id").agg(F.min("problem").alias("problem"))
        whole = members.groupBy("event_id", "root_id").agg(F.sort_array(F.collect_set("id")).alias("members"))
        out = save(roots.join(whole, ["event_id", "root_id"]).join(bad, ["event_id", "root_id"], "left"))
        kept.append(out)
    return out


def with_counterparts(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """The messages ``ids (id)`` and all that share a turn with one of them: where their counterparts are."""
    own = messages.join(ids.select("id"), "id", "left_semi").select(messages.columns)
    return own.unionByName(turn_peers(messages, ids)).dropDuplicates(["id"])

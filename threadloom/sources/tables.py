"""Canonical tables of the engine, derived from stored ones; columns are pruned to what is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.blocks import BLOCK


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """``id, thread_id, position, role, text, turn_id``; a user's message opens a turn, '' before the first."""
    rows = read(spark, folder, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order))
    turn = F.when(F.col("n") == 0, "").otherwise(F.concat_ws(":", "conv_id", "n"))
    name = F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn")
    return rows.select(name.alias("id"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("position"), "role", "text", turn.alias("turn_id"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``message_id, chunk_index, thread_id, vector``: five stored vectors make up a message's chunks."""
    rows = read(spark, folder, "embeddings")
    return rows.select(F.expr("vec_id div 5").alias("message_id"), (F.col("vec_id") % 5).alias("chunk_index"), F.col("label").alias("thread_id"), "vec_id", F.col("embedding").alias("vector"))


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from the two messages before each one, and from the thread's first where position > 4."""
    rows = read(spark, folder, "conversations").select("conv_id", "turn")
    to = rows.select("conv_id", F.col("turn").alias("t"))
    back = to.withColumn("f", F.explode(F.array(F.col("t") - 1, F.col("t") - 2, F.when(F.col("t") > 4, 0))))
    pairs = back.filter("f >= 0").distinct().join(rows.select("conv_id", F.col("turn").alias("f")), ["conv_id", "f"], "left_semi")
    name = lambda c: F.concat(F.lit("c"), "conv_id", F.lit("-"), c)
    return pairs.select(name("f").alias("from_id"), name("t").alias("to_id"), F.lit(0.9).alias("score"), F.lit(4).alias("source"), F.col("conv_id").alias("thread_id"), F.col("f").alias("from_position"), F.col("t").alias("to_position"))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """``id, thread_id, stage, ms, created_at``: one measured stage per stored event."""
    rows = read(spark, folder, "events")
    return rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("thread_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("ts").alias("created_at"), "props")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """``messages`` with their ``content`` blocks: text, and by position thinking, calls, results and attachments."""
    rows = messages(spark, folder)
    t, text = F.col("position"), F.coalesce("text", F.lit(""))
    name = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))

    def block(kind: str, **fields: Column) -> Column:
        values = {"kind": F.lit(kind), **fields}
        names = [(c.split(":")[0], c.split(":")[1]) for c in BLOCK[len("struct<") : -1].split(",")]
        return F.struct(*[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in names])

    made = [
        F.when(t % 7 != 6, block("text", text=text)),
        F.when(t % 3 == 1, block("thinking", text=F.concat(F.lit("so "), F.left(text, F.lit(20))), signature=F.when(t % 2 == 1, F.encode(F.lit("x"), "utf-8")))),
        F.when(t % 4 == 1, block("tool_call", call_id=name("k", t), name=F.lit("lookup"), arguments=F.concat(F.lit('{"q":"'), t.cast("string"), F.lit('"}')))),
        F.when(t % 4 == 2, block("tool_result", call_id=name("k", t - 1), text=F.left(text, F.lit(10)), is_error=t % 8 == 2)),
        F.when(t % 5 == 3, block("attachment", filename=name("f", t), path=F.lit("/a"), media_type=F.lit("text/plain"), inlined_text=F.left(text, F.lit(5)))),
    ]
    return rows.withColumn("content", F.filter(F.array(*made), lambda b: b.isNotNull()))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``message_id, thread_id, role, position, block_no`` and the block's fields: one row a block."""
    rows = contents(spark, folder).select(F.col("id").alias("message_id"), "thread_id", "role", "position", F.posexplode("content").alias("block_no", "b"))
    return rows.select("message_id", "thread_id", "role", "position", "block_no", "b.*")


def ancestry(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance among the messages of ``vectors``: within each twenty, from the one and the five before."""
    rows = vectors(spark, folder).select("message_id").distinct()
    to = rows.select(F.col("message_id").alias("to_id"), F.explode(F.array(F.struct(F.lit(1).alias("back"), F.lit(0.9).alias("score")), F.struct(F.lit(5).alias("back"), F.lit(0.7).alias("score")))).alias("x"))
    to = to.select((F.col("to_id") - F.col("x.back")).alias("from_id"), "to_id", "x.score").filter("from_id >= 0 and from_id div 20 = to_id div 20")
    return to.join(rows.withColumnRenamed("message_id", "from_id"), "from_id", "left_semi").select("from_id", "to_id", "score")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the parts that a model's replies emit, eight days of a user being a turn; see ``operators.fold``."""
    rows = read(spark, folder, "events")
    kinds = {"view": "text", "signup": "thinking", "click": "tool_call", "purchase": "tool_result"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")], F.lit("error"))
    number = F.col("event_id")
    paired = F.col("event_type").isin("click", "purchase") & (number % 89 != 0)
    return rows.select(
        F.col("user_id").alias("thread_id"),
        F.concat(F.lit("d"), F.expr("day(ts) div 8")).alias("turn_id"),
        number.alias("seq"),
        kind.alias("kind"),
        F.concat("event_type", number).alias("text"),
        F.when((F.col("event_type") == "signup") & (number % 4 == 0), F.concat(F.lit("s"), number)).alias("signature"),
        F.when(paired, F.concat(F.lit("k"), number % 5)).alias("call_id"),
        F.lit("f").alias("name"),
        F.col("props").alias("arguments"),
        F.col("ts"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Customers, nations and regions as text files ``path, text`` that include each other; every 50th customer's has a fault."""
    text = lambda c: F.col(c).cast("string")
    lines = lambda *parts: F.concat(*[x for p in parts for x in (p, F.lit("\n"))])
    c, n, r = (read(spark, folder, t) for t in ("customer", "nation", "region"))
    own = F.concat(F.lit("customer/"), text("c_custkey"), F.lit(".adoc"))
    fault = F.when(F.col("c_custkey") % 100 == 0, F.concat(F.lit("include::"), text("c_custkey"), F.lit(".adoc[]"))).when(F.col("c_custkey") % 50 == 0, F.lit("include::../gone.adoc[]")).otherwise("// sound")
    customers = c.select(own.alias("path"), lines(F.lit("{nation}?"), F.concat(F.lit("include::../nation/./"), text("c_nationkey"), F.lit(".adoc[]")), F.concat("c_name", F.lit(" of {nation}, {region}; {none}")), F.lit(":nation: nowhere"), fault, F.lit("{nation}")).alias("text"))
    nations = n.select(F.concat(F.lit("nation/"), text("n_nationkey"), F.lit(".adoc")).alias("path"), lines(F.concat(F.lit("include::../region/"), text("n_regionkey"), F.lit(".adoc[]")), F.concat(F.lit(":nation: "), "n_name"), F.lit("{nation} in {region}")).alias("text"))
    regions = r.select(F.concat(F.lit("region/"), text("r_regionkey"), F.lit(".adoc")).alias("path"), F.concat(F.lit("// a region\n:region: "), "r_name", F.lit("\n")).alias("text"))
    return customers.unionByName(nations).unionByName(regions)

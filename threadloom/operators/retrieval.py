"""Vector retrieval for many queries in one job.

Queries are a stated set: they are broadcast only while their number is checked to be small, else
they meet the table in blocks. Predicates go below the ranking, so no over-fetching is needed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from threadloom.functions import vectors as V
from threadloom.operators import tiles
from threadloom.sources.scratch import save, save_all, scratch

#: Queries to broadcast at most; more are worked off in blocks of this size.
BLOCK = 10_000
BLOCK_BYTES = 256 << 20
OVERFETCH, LEAST_SHORTLIST = 16, 128
#: Share of a query's rows that its shortlist holds at least; recall depends on it, whatever the table's size.
SHARE = 1 / 3


def best(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def blocks_of(queries: DataFrame, key: str) -> list[DataFrame]:
    """``queries`` as blocks of about ``BLOCK`` queries and ``BLOCK_BYTES`` (as JSON, vectors and lists included) at most, dealt by ``key``."""
    size = queries.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    if blocks == 1:
        return [queries]
    queries = save(queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))))
    return [queries.filter(F.col("_block") == b).drop("_block") for b in range(blocks)]


def pairs(queries: DataFrame, table: DataFrame, ranked: Callable[[DataFrame], DataFrame], key: str = "query_id") -> DataFrame:
    """``ranked`` over every query with every row, each a row of the plan; ``key`` deals the queries to blocks.

    A block is broadcast. Several blocks are worked off one after the other into one table.
    """
    parts = blocks_of(queries, key)
    if len(parts) == 1:
        return ranked(table.crossJoin(F.broadcast(queries)))
    return save_all(ranked(table.crossJoin(F.broadcast(part))) for part in parts)


def first_of(rows: DataFrame, keys: list[str], of: str, tie: str) -> DataFrame:
    """Of the rows of each ``keys, of`` that of the best score, the one of the smallest ``tie`` among equal ones."""
    rest = [c for c in rows.columns if c not in (*keys, of)]
    top = F.max_by(F.struct(*rest), F.struct("score", -F.col(tie))).alias("b")
    return rows.groupBy(*keys, of).agg(top).select(*keys, of, "b.*")


def tiled(queries: DataFrame, table: DataFrame, task: Callable[[Callable[[], pa.Table]], tiles.Task], columns: list[str], ranked: Callable[[DataFrame], DataFrame], key: str, dealt: bool = False) -> DataFrame:
    """``ranked`` over what ``task`` (see ``tiles``) leaves of every query with every row: queries' and rows' ``columns`` and ``score``.

    A block of queries goes to all tasks, one block after the other; the table is dealt once, unless
    it is already.
    """
    context = table.sparkSession.sparkContext
    kinds = {f.name: f.dataType for f in (*table.schema, *queries.schema)}
    schema = StructType([StructField(c, kinds[c]) for c in columns] + [StructField("score", DoubleType())])

    def one(part: DataFrame) -> DataFrame:
        sent = context.broadcast(part.toArrow())
        return ranked(table.mapInArrow(task(lambda: sent.value), schema))

    parts = blocks_of(queries, key)
    if not dealt:
        table = table.repartition(context.defaultParallelism)
    if len(parts) == 1:
        return one(queries)
    if not dealt:
        table = save(table)
    return save_all(one(part) for part in parts)


def closest(
    queries: DataFrame,
    table: DataFrame,
    k: int,
    keys: tuple[str, ...] = ("query_id",),
    of: str = "vec_id",
    tie: str | None = None,
    along: tuple[str, ...] = (),
    gone: tuple[Column, Column] | None = None,
    same: tuple[Column, Column] | None = None,
    open_: bool = False,
    probing: Callable[[pa.Table], Callable[[int], np.ndarray]] | None = None,
) -> DataFrame:
    """The exact ``k`` best ``of`` each query by cosine: ``keys, of, tie, along, score, rank``; ties go to the smaller ``of``.

    With ``tie``, an ``of`` has several rows and counts by its best, the one of the smallest ``tie``
    among equal ones. ``gone``: a row's key and a query's list of such keys that don't count.
    ``same``: a row's and a query's value, which must be equal (``open_``: or the query's null).
    These go below the ranking. Pairs are never rows: each task leaves ``k`` rows a query at most.
    ``probing`` is for ``vector_index``, whose table comes dealt and has a ``bucket``.
    """
    names, keys = [of, *([tie] if tie else []), *along], list(keys)
    asked, rows = [*keys, F.col("query_vector").alias("_vector")], [*names, F.col("vector").alias("_vector")]
    if probing:
        rows.append("bucket")
        asked += [c for c in ("_least",) if c in queries.columns]
    for name, both in (("_gone", gone), ("_same", same)):
        if both:
            rows.append(both[0].alias(name))
            asked.append(both[1].alias(name))

    def ranked(found: DataFrame) -> DataFrame:
        found = first_of(found, keys, of, tie) if tie else found
        return best(found, keys, [F.desc("score"), F.col(of)], k, "rank")

    task = lambda sent: tiles.closest(sent, keys, names, k, bool(tie), open_, probing)
    return tiled(queries.select(*asked), table.select(*rows), task, [*keys, *names], ranked, keys[0], bool(probing)).select(*keys, *names, "score", "rank")


def scored(queries: DataFrame, table: DataFrame, where: Column | None = None, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``then`` over the cosine ``score`` of all rows with all queries; norms are computed once a row."""
    queries = queries.withColumn("query_norm", V.norm("query_vector"))
    table = table.withColumn("norm", V.norm("vector"))

    def one(rows: DataFrame) -> DataFrame:
        rows = rows if where is None else rows.filter(where)
        score = V.cosine_of("vector", "query_vector", F.col("norm") * F.col("query_norm"))
        return then(rows.withColumn("score", F.round(score, 6)).drop("norm", "query_norm"))

    return pairs(queries, table, one)


def nearest(queries: DataFrame, table: DataFrame, k: int, where: Column | None = None, gone: tuple[Column, Column] | None = None, same: tuple[Column, Column] | None = None) -> DataFrame:
    """The exact ``k`` nearest rows of each query by cosine: ``query_id, vec_id, score, rank``.

    ``queries (query_id, query_vector, ...)``; ``gone`` and ``same`` as in ``closest``. ``where``
    may use columns of both sides, but makes a row of every pair: prefer the other two.
    """
    if where is None:
        return closest(queries, table, k, gone=gone, same=same)
    top = lambda rows: best(rows.select("query_id", "vec_id", "score"), ["query_id"], [F.desc("score"), F.col("vec_id")], k, "rank")
    return scored(queries, table, where, top)


def itself() -> tuple[Column, Column]:
    """For ``gone``: no query finds the row of its own id."""
    return F.col("vec_id"), F.array("query_id")


def first_ranks(queries: DataFrame, table: DataFrame, same: tuple[Column, Column], gone: tuple[Column, Column] | None = None) -> DataFrame:
    """The rank of each query's best row among those of the ``same`` value, null where it has none: ``query_id, rank``.

    All rows that are not ``gone`` are ranked, by cosine, then ``vec_id``; those before the hit are
    counted in tiles. A query that meets no row has no rank row. ``same`` and ``gone`` as in ``closest``.
    """
    with scratch() as kept:
        top = nearest(queries, table, 1, gone=gone, same=same).select("query_id", F.nanvl("score", F.lit(float("inf"))).alias("_top"), F.col("vec_id").alias("_id"))
        asked = queries.select("query_id", F.col("query_vector").alias("_vector"), *([gone[1].alias("_gone")] if gone else [])).join(top, "query_id", "left")
        asked = save(asked.withColumn("_id", F.coalesce("_id", F.lit(0))))
        rows = table.select("vec_id", F.col("vector").alias("_vector"), F.lit(0).cast("long").alias("met"), *([gone[0].alias("_gone")] if gone else []))
        counts = lambda found: found.groupBy("query_id").agg(F.sum("met").alias("met"), F.sum("score").cast("long").alias("n"))
        found = tiled(asked, rows, lambda sent: tiles.ahead(sent, ["query_id"]), ["query_id", "met"], counts, "query_id")
        rank = F.when(F.col("_top").isNotNull(), F.col("n") + 1).alias("rank")
        out = save(found.filter("met > 0").join(asked.select("query_id", "_top"), "query_id").select("query_id", rank))
        kept.append(out)
    return out


def coded(table: DataFrame) -> DataFrame:
    """``table`` with its sign code, int8 code and scale."""
    table = table.withColumn("scale", V.int8_scale("vector"))
    return table.withColumns({"sign": V.sign_code("vector"), "code": V.int8_code("vector", "scale")}).drop("vector")


def closest_codes(queries: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of each query with the fewest differing signs: ``query_id, vec_id, distance, rank``."""
    queries = queries.withColumn("query_sign", V.sign_code("query_vector"))
    table = table.select("vec_id", V.sign_code("vector").alias("sign"))

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.select("query_id", "vec_id", V.hamming("sign", "query_sign").alias("distance"))
        return best(rows, ["query_id"], [F.col("distance"), F.col("vec_id")], k, "rank")

    return pairs(queries, table, ranked)


def two_stage(queries: DataFrame, table: DataFrame, shortlist: int, where: Column | None = None, share: float = SHARE) -> DataFrame:
    """A shortlist by Hamming distance of sign codes, scored by int8 codes: ``query_id, ..., score``.

    A query's shortlist is all rows within the radius that holds at least ``shortlist`` rows and
    ``share`` of its rows. The radius comes from counts by distance, so no task ranks a query's
    rows, and recall doesn't fall as the table grows.
    """
    queries = queries.withColumn("query_sign", V.sign_code("query_vector"))
    table = coded(table)

    def near(rows: DataFrame) -> DataFrame:
        rows = rows if where is None else rows.filter(where)
        rows = rows.withColumn("distance", V.hamming("sign", "query_sign"))
        counts = rows.groupBy("query_id", "distance").agg(F.count("*").alias("c"))
        radius = _radius(counts, shortlist, share)
        return rows.join(F.broadcast(radius), "query_id").filter("distance <= radius").drop("radius")

    rows = pairs(queries, table, near)
    return rows.withColumn("score", F.round(V.int8_score("query_vector", "code", "scale"), 6))


def radii(queries: DataFrame, table: DataFrame, shortlist: int, share: float) -> DataFrame:
    """``query_id, radius``: the Hamming distance within which a query has at least ``shortlist`` rows and ``share`` of its rows."""

    def counted(found: DataFrame) -> DataFrame:
        return _radius(found.groupBy("query_id", "distance").agg(F.sum("score").cast("long").alias("c")), shortlist, share)

    asked = queries.select("query_id", V.sign_code("query_vector").alias("_sign"))
    rows = table.select(F.col("sign").alias("_sign"), F.lit(0).alias("distance"))
    return tiled(asked, rows, lambda sent: tiles.distances(sent, ["query_id"]), ["query_id", "distance"], counted, "query_id")


def _radius(counts: DataFrame, shortlist: int, share: float) -> DataFrame:
    query = Window.partitionBy("query_id")
    upto = F.sum("c").over(query.orderBy("distance").rowsBetween(Window.unboundedPreceding, 0))
    need = F.greatest(F.lit(shortlist), F.ceil(F.sum("c").over(query) * F.lit(share)))
    within = counts.withColumns({"before": upto - F.col("c"), "need": need}).filter("before < need")
    return within.groupBy("query_id").agg(F.max("distance").alias("radius"))


def shortlisted(queries: DataFrame, table: DataFrame, k: int, shortlist: int, of: str = "vec_id", tie: str | None = None, share: float = SHARE) -> DataFrame:
    """The ``k`` best ``of`` each query's ``two_stage``: ``query_id, of, tie, score, rank``; see ``closest``.

    The table is gone through twice, for the radius and for the scores within it, both in tiles.
    """
    names, keys = [of, *([tie] if tie else [])], ["query_id"]
    with scratch() as kept:
        table = save(coded(table).select(*names, "sign", "code", "scale"))
        radius = radii(queries, table, shortlist, share)
        asked = queries.select("query_id", F.col("query_vector").alias("_vector"), V.sign_code("query_vector").alias("_sign")).join(radius.withColumnRenamed("radius", "_radius"), "query_id")

        def ranked(found: DataFrame) -> DataFrame:
            found = first_of(found, keys, of, tie) if tie else found
            return best(found, keys, [F.desc("score"), F.col(of)], k, "rank")

        rows = table.select(*names, F.col("sign").alias("_sign"), F.col("code").alias("_code"), "scale")
        out = save(tiled(save(asked), rows, lambda sent: tiles.reranked(sent, keys, names, k, bool(tie)), [*keys, *names], ranked, "query_id"))
        kept.append(out)
    return out.select("query_id", *names, "score", "rank")


def search(queries: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """Best messages of each query: ``query_id, message_id, vec_id, score, rank``."""
    found = shortlisted(queries, table, limit, max(OVERFETCH * limit, LEAST_SHORTLIST), "message_id", "vec_id")
    return found.select("query_id", "message_id", "vec_id", "score", "rank")


def enriched(found: DataFrame, messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Search hits with their message's text and thread name; a hit without message keeps nulls."""
    rows = found.join(messages.select(F.col("id").alias("message_id"), "thread_id", "text"), "message_id", "left")
    return rows.join(threads.select("thread_id", F.col("name").alias("thread_name")), "thread_id", "left")


def pooled(table: DataFrame) -> DataFrame:
    """The mean vector of each message's chunks, added up in the order of the chunks."""
    rows = table.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "vector"))).alias("chunks"))
    zero = F.transform(F.col("chunks")[0]["vector"], lambda _: F.lit(0.0))
    total = F.aggregate("chunks", zero, lambda t, c: F.zip_with(t, c["vector"], lambda x, y: x + y.cast("double")))
    return rows.select("message_id", F.transform(total, lambda x: x / F.size("chunks")).alias("vector"))


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Share of the exact rows of each query that were found."""
    hits = exact.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.lit(k)).alias("recall"))


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """Late interaction: the sum over query tokens of the best document token.

    ``query_tokens (query_id, token, query_vector)``, a stated set; ``doc_tokens (doc_id, vector)``.
    """

    def best_tokens(rows: DataFrame) -> DataFrame:
        rows = rows.select("query_id", "token", "doc_id", V.dot("vector", "query_vector").alias("s"))
        return rows.groupBy("query_id", "token", "doc_id").agg(F.max("s").alias("s"))

    return pairs(query_tokens, doc_tokens, best_tokens).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def draw(table: DataFrame, events: DataFrame, n: int, exclude: DataFrame | None = None, key: str = "vec_id", scoped: bool = False) -> DataFrame:
    """A repeatable pseudo-random sample of rows for each event ``(event_id, seed)``.

    Rows ``(row_no, vec_id)`` are ordered by ((row_no + seed) * 2654435761) modulo 2^32.
    ``exclude (event_id, key)`` leaves rows out: an event's candidates and what it has already,
    which caps bound, so they go along as one list an event. ``scoped``: events have a
    ``scope_thread``, and where it is not null only rows of that ``thread_id`` are drawn.
    """
    asked, rows = ["event_id", F.col("seed").cast("long").alias("seed")], ["vec_id", F.col("row_no").cast("long").alias("row_no")]
    if exclude is not None:
        gone = exclude.groupBy("event_id").agg(F.collect_set(key).alias("_gone"))
        events = events.join(gone, "event_id", "left")
        asked.append("_gone")
        rows.append(F.col(key).alias("_gone"))
    if scoped:
        asked.append(F.col("scope_thread").alias("_same"))
        rows.append(F.col("thread_id").alias("_same"))
    task = lambda sent: tiles.drawn(sent, ["event_id"], n, scoped)
    few = tiled(events.select(*asked), table.select(*rows), task, ["event_id", "vec_id", "row_no"], lambda found: best(found, ["event_id"], [F.desc("score"), F.col("vec_id")], n, "draw_rank"), "event_id")
    few = few.select("event_id", "vec_id", F.col("row_no").alias("_no"), (-F.col("score")).cast("long").alias("draw_key")).distinct()
    # a row that is stored several times counts as often
    drawn = few.join(table, "vec_id").filter(F.col("_no") == F.col("row_no")).drop("_no")
    return best(drawn, ["event_id"], [F.col("draw_key"), F.col("vec_id")], n, "draw_rank")

"""Connected components, and linking the members of buckets without expanding all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.work import free, save, scratch


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: every node has one edge down, or only edges up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(edges.select("v", F.lit(0)))
    odd = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return odd.filter("down > 1 or (down = 1 and least = 0)").isEmpty()


def _star(rows: DataFrame) -> DataFrame:
    """Smallest neighbour of every ``u``; written, so that the join after it can split hot nodes."""
    return save(rows.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _star(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _star(down)
    kept = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``edges (u, v)`` that reaches a smaller id: the smallest.

    The smallest ids themselves have no row.

    Alternating large-star and small-star steps; each step is written to shared storage and
    deleted after the next. Self-loops and repeated edges change nothing; an empty table gives an
    empty table.
    """
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = save(down.distinct())
    while not _settled(now):
        before = now
        with scratch() as kept:
            now = save(_small_star(save(_large_star(before))))
            kept.append(now)
        free(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def more_links(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` as ``components`` gives them, after further ``edges``: only links between parts are worked off."""
    ends = edges.select("u", "v")
    for end in ("u", "v"):
        part = labels.select(F.col("id").alias(end), "component")
        ends = ends.join(part, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    with scratch() as kept:
        moved = save(components(save(ends.filter("u <> v").distinct())))
        kept.append(moved)
    now = labels.join(moved.toDF("component", "lower"), "component", "left")
    return now.select("id", F.coalesce("lower", "component").alias("component")).union(moved)


def link_buckets(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    possible: Callable[[Column, Column], Column],
    marks: DataFrame | None = None,
    pivots: int = 1,
) -> DataFrame:
    """Components over all verified links between ids that share a bucket.

    ``members (key, id, mark)``: distinct rows, the mark depends on the id alone; with ``c``, the
    size of the bucket, there are no buckets of one. ``verify`` keeps
    the true links of distinct pairs ``(u, v)`` with u < v. First every member meets its bucket's
    lowest id, then a random member of its bucket (buckets differ, so it meets several), then every
    pair of a bucket of three or more that is not yet in one component and not yet tried. Links
    within a component that is already connected change no component, so groups of thousands of
    alike members cost a few pairs each, and no link is lost. Where links are loose, so that large
    buckets hold many parts, ``pivots`` random members a bucket leave less for the last step.

    Every one of these joins compares the marks of both sides inside the join and passes only
    pairs on whose marks ``possible`` does not rule a link out; a null mark rules out nothing. So
    chance meetings are comparisons, but no rows. Large marks come as ``marks (id, mark)`` instead
    and are compared in the last join only. Returns ``(id, component)`` of the linked ids other
    than their component's smallest.
    """
    spark = members.sparkSession
    early = marks is None
    with scratch() as kept:
        members = members if early else members.withColumn("mark", F.lit(None).cast("int"))
        if "c" not in members.columns:
            sizes = save(members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
            members = save(members.join(sizes, "key"))
            free(sizes)
        tried = labels = None
        for turn in ("low", "mixed", "all"):
            now = members.withColumn("part", F.col("id"))
            if turn != "low":
                now = now.filter("c > 2")
            if labels is not None:
                now = now.drop("part").join(labels, "id", "left").select("key", "id", "mark", F.coalesce("component", "id").alias("part"))
                now = save(now)
            order = F.col("id") if turn == "low" else F.xxhash64("id", "key", F.lit(turn))
            pivot = F.min_by(F.struct("id", "part", "mark"), order).alias("pivot")
            ends = [F.min("part").alias("p0"), F.max("part").alias("p1")]
            if turn == "mixed" and pivots > 1:
                # one pivot of each share of a bucket
                share = F.pmod(F.xxhash64("id", F.lit("share")), F.lit(pivots)).alias("share")
                mixed = now.groupBy("key", share).agg(*ends, pivot)
                whole = mixed.groupBy("key").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1")).filter("p0 < p1").select("key")
                mixed = mixed.join(whole, "key")
            else:
                mixed = now.groupBy("key").agg(*ends, pivot).filter("p0 < p1")
            mixed = save(mixed.select("key", F.col("pivot.id").alias("id2"), F.col("pivot.part").alias("part2"), F.col("pivot.mark").alias("mark2")))
            if mixed.isEmpty():
                break
            compared = early or turn == "all"
            apart = F.coalesce(possible(F.col("mark"), F.col("mark2")), F.lit(True)) if compared else F.lit(True)
            if turn == "all":
                left = now.join(mixed.select("key"), "key").select("key", "id", "part", "mark")
                left = save(left if early else left.drop("mark").join(marks, "id"))
                once = F.lit(True)
                if early:
                    # a pair comes out of the first bucket that it shares, not of all
                    whole = left
                    left = save(whole.join(whole.groupBy("id").agg(F.collect_set("key").alias("keys")), "id"))
                    free(whole)
                    once = F.col("key") == F.array_min(F.array_intersect("keys", "keys2"))
                right = left.select("key", F.col("id").alias("id2"), F.col("part").alias("part2"), F.col("mark").alias("mark2"), *([F.col("keys").alias("keys2")] if early else []))
                pairs = left.join(right, "key").filter(F.expr("id < id2 and part <> part2") & apart & once)
            else:
                pairs = now.join(mixed, "key").filter(F.expr("part <> part2") & apart)
            pairs = pairs.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["u", "v"], "left_anti")
            pairs = save(pairs)
            if pairs.isEmpty():
                continue
            tried = pairs if tried is None else tried.union(pairs)
            with scratch() as links:
                found = save(verify(pairs))
                links.append(found)
            before = labels
            with scratch() as links:
                labels = save(components(found) if before is None else more_links(before, found))
                links.append(labels)
            if before is not None:
                free(before)
        if labels is None:
            return spark.createDataFrame([], "id long, component long")
        kept.append(labels)
    return labels

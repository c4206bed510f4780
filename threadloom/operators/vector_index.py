"""A bucketed vector index: coarse centres, every row in the bucket of its nearest one, exact or probed search.

The centres are fitted by k-means on a bounded sample; every row of the table goes into a bucket,
stored in a folder of its own, so that a search reads only the buckets it probes. How many those are
is measured: a bounded sample of rows asks the whole table, and the index keeps how many of the
nearest buckets hold the wanted share of what they find. Where vectors cluster, that is a few of
buckets that grow as the square root of the table, so the share of rows scored falls as it grows;
where they have no structure at all, no index helps, and the measure says so. Each bucket keeps its cone, the widest angle between its centre and a row: a query can find nothing
better in it than at the angle to the cone's edge. An exact search probes the nearest buckets first
and then all whose cone could still beat the k-th score; a probed one stops after the first step.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.functions import vectors as V
from threadloom.operators import retrieval, tiles
from threadloom.operators.retrieval import best
from threadloom.sources.scratch import save, scratch, shared_dir

#: Rows that the centres are fitted on at most, and centres at most.
SAMPLE, MOST = 20_000, 4096
#: Rows that ask the table to measure the number of probes, what they ask for, and the share to be found.
ASKING, ASKED_FOR, RECALL = 64, 10, 0.95
#: The bucket of rows without direction: null, zero or of another width. They score 0 with all queries.
ODD = -1
#: Scores have six places, so a bound must leave half a unit.
_SLACK = 1e-6


class Index(NamedTuple):
    """``centers (bucket, center, cone, n)``, a row a bucket; ``rows``, the table with ``bucket``; ``probes`` that recall takes."""

    centers: DataFrame
    rows: DataFrame
    probes: int


def build(table: DataFrame, buckets: int | None = None, sample: int = SAMPLE, width: int | None = None, folder: str | None = None, recall: float = RECALL) -> Index:
    """Index ``table (vec_id, vector, ...)``; all its columns stay.

    ``sample`` rows at most, those of the smallest hash of ``vec_id``, fit the centres. ``width`` is
    the number of dimensions (default: the commonest). What is written to ``folder`` is read by ``load``.
    """
    spark = table.sparkSession
    folder = folder or shared_dir(spark)
    usable = F.col("vector").isNotNull() & (V.norm("vector") > 0)
    if width is None:
        sizes = table.filter(usable).groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
        width = sizes["w"] if sizes else 0
    usable = F.coalesce(usable & (F.size("vector") == width), F.lit(False))
    fine = table.filter(usable)
    with_direction = lambda df: df.withColumn("_direction", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    n = fine.count()
    parts = []
    if n:
        k = buckets or max(1, min(MOST, round(math.sqrt(n))))
        drawn = save(fine.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample))
        model = KMeans(k=k, seed=5, maxIter=15, distanceMeasure="cosine", featuresCol="_direction", predictionCol="bucket").fit(with_direction(drawn))
        parts.append(model.transform(with_direction(fine)).drop("_direction"))
        middles = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    else:
        middles = []
    rows = table.filter(~usable).withColumn("bucket", F.lit(ODD))
    for part in parts:
        rows = rows.unionByName(part.select(rows.columns))
    rows.repartitionByRange(F.col("bucket"), F.col("vec_id")).write.partitionBy("bucket").parquet(f"{folder}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    centers = spark.createDataFrame([*middles, (ODD, None)], "bucket int, center array<double>")
    turned = stored.join(F.broadcast(centers), "bucket").groupBy("bucket").agg(F.min(V.cosine("vector", "center")).alias("near"), F.count("*").alias("n"))
    cone = F.acos(F.greatest(F.least("near", F.lit(1.0)), F.lit(-1.0)))
    centers.join(turned, "bucket").select("bucket", "center", cone.alias("cone"), "n").coalesce(1).write.parquet(f"{folder}/centers")
    facts = (rows.schema.json(), 1)
    spark.createDataFrame([facts], "schema string, probes int").coalesce(1).write.parquet(f"{folder}/facts/first")
    index = load(spark, folder)
    if n:
        probes = _probes(index, fine, recall)
        spark.createDataFrame([(facts[0], probes)], "schema string, probes int").coalesce(1).write.parquet(f"{folder}/facts/measured")
        index = index._replace(probes=probes)
    return index


def load(spark: SparkSession, folder: str) -> Index:
    """The index that ``build`` wrote to ``folder``; one of an empty table has no files of rows."""
    facts = spark.read.schema("schema string, probes int").option("recursiveFileLookup", "true").parquet(f"{folder}/facts").orderBy(F.desc("probes")).first()
    centers = spark.read.schema("bucket int, center array<double>, cone double, n long").parquet(f"{folder}/centers")
    rows = spark.read.schema(StructType.fromJson(json.loads(facts["schema"]))).parquet(f"{folder}/rows")
    return Index(centers, rows, facts["probes"])


def _probes(index: Index, table: DataFrame, recall: float) -> int:
    """How many nearest buckets hold a share ``recall`` of what a sample of rows finds in the whole table."""
    asking = save(table.orderBy(F.xxhash64("vec_id", F.lit("asking")), "vec_id").limit(ASKING).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector")))
    found = retrieval.nearest(asking, index.rows.select("vec_id", "vector"), ASKED_FOR, gone=retrieval.itself())
    places = found.join(index.rows.select("vec_id", "bucket"), "vec_id").join(_met(index, asking, ["query_id"]), ["query_id", "bucket"])
    counts = {r["place"]: r["count"] for r in places.groupBy("place").count().collect()}
    total, seen = sum(counts.values()), 0
    for place in sorted(counts):
        seen += counts[place]
        if seen >= recall * total:
            return place
    return 1


def _met(index: Index, queries: DataFrame, key: list[str]) -> DataFrame:
    """Every query with every bucket: ``bound``, the best score it may hold, and ``place`` by nearness."""
    rows = queries.select(*key, "query_vector").crossJoin(F.broadcast(index.centers))
    cosine = F.greatest(F.least(V.cosine("query_vector", "center"), F.lit(1.0)), F.lit(-1.0))
    rows = rows.withColumn("near", F.when(F.col("center").isNotNull(), cosine).otherwise(-1.0))
    angle = F.greatest(F.acos("near") - F.col("cone"), F.lit(0.0))
    # a query without direction scores 0 with all rows, as rows without direction do
    flat = F.col("center").isNull() | ~F.coalesce(V.norm("query_vector") > 0, F.lit(False)) | (F.size("query_vector") != F.size("center"))
    rows = rows.withColumn("bound", F.when(flat, 0.0).otherwise(F.cos(angle)))
    return best(rows, key, [F.desc("near"), F.col("bucket")], MOST + 1, "place").select(*key, "bucket", "bound", "place", "n")


def nearest(
    index: Index,
    queries: DataFrame,
    k: int,
    where: Column | None = None,
    key: tuple[str, ...] = ("query_id",),
    of: str = "vec_id",
    probes: int | None = None,
    exact: bool = True,
    tie: str | None = None,
    gone: tuple[Column, Column] | None = None,
    same: tuple[Column, Column] | None = None,
) -> DataFrame:
    """The ``k`` best ``of`` each query by cosine: ``key, of, tie, score, rank``.

    ``queries (key, query_vector, ...)`` are a stated set. ``tie``, ``gone`` and ``same`` are those
    of ``retrieval.closest``. ``where`` may use columns of both sides, but makes a row of every pair
    that is scored: prefer the other two. All go below the ranking.
    ``exact`` widens to all buckets whose bound reaches the k-th score (all, where fewer are found);
    otherwise the ``probes`` nearest buckets are all (as many as the index measured, if not given).
    """
    key, probes = list(key), probes or index.probes
    order = [F.desc("score"), F.col(of)]
    names = [of, *([tie] if tie else [])]
    rest = lambda found: queries.join(found.groupBy(*key).agg(F.when(F.count("*") >= k, F.min("score")).alias("_least")), key, "left")

    def both(found: DataFrame, more: DataFrame) -> DataFrame:
        rows = found.drop("rank").unionByName(more.drop("rank"))
        return best(retrieval.first_of(rows, key, of, tie) if tie else rows, key, order, k, "rank")

    with scratch() as kept:
        if where is None:
            cells = [c for c in (gone, same) if c]
            rows = index.rows.select("bucket", "vec_id", *[c for c in names if c != "vec_id"], "vector", *[c[0].alias(f"_of{i}") for i, c in enumerate(cells)])
            # whole buckets, one after the other, but a large one in parts
            rows = save(rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, "bucket", "vec_id").sortWithinPartitions("bucket"))
            stored = [(F.col(f"_of{i}"), c[1]) for i, c in enumerate(cells)]
            left = {"gone": stored[0] if gone else None, "same": stored[-1] if same else None}
            centers = [(r["bucket"], r["center"], r["cone"]) for r in index.centers.collect()]
            found = save(retrieval.closest(queries, rows, k, tuple(key), of, tie, **left, probing=tiles.probing(centers, probes, False, _SLACK)))
            if exact:
                more = retrieval.closest(rest(found), rows, k, tuple(key), of, tie, **left, probing=tiles.probing(centers, probes, True, _SLACK))
                found = save(both(found, more))
            kept.append(found)
            return found
        met = save(_met(index, queries, key))

        def top(probed: DataFrame) -> DataFrame:
            rows = index.rows.join(probed.select(*key, "bucket"), "bucket").drop("bucket").join(queries, key).filter(where)
            rows = rows.select(*key, *names, F.round(V.cosine("vector", "query_vector"), 6).alias("score"))
            return best(retrieval.first_of(rows, key, of, tie) if tie else rows, key, order, k, "rank")

        found = save(top(met.filter(F.col("place") <= probes)))
        if exact:
            reached = rest(found).select(*key, "_least")
            more = met.filter(F.col("place") > probes).join(reached, key).filter(F.col("_least").isNull() | (F.col("bound") + _SLACK >= F.col("_least")))
            found = save(both(found, top(more)))
        kept.append(found)
    return found


def share_scored(index: Index, queries: DataFrame, probes: int | None = None) -> float:
    """Share of all pairs of queries and rows that a probed search scores."""
    probes = probes or index.probes
    met = _met(index, queries, ["query_id"])
    sums = met.agg(F.sum(F.when(F.col("place") <= probes, F.col("n"))).alias("seen"), F.sum("n").alias("all")).first()
    return (sums["seen"] or 0) / (sums["all"] or 1)

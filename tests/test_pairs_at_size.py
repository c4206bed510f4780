"""Queries of all pairs: pairs are no rows of a plan, and the number of jobs doesn't grow with the tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import retrieval, series, telemetry
from threadloom.plans import catalog

ROWS, ASKING = 3000, 150


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d, draw = tmp_path_factory.mktemp("vectors"), random.Random(8)
    rows = [(k, [draw.gauss(0, 1) for _ in range(16)], k % 10) for k in range(ROWS)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.range(ROWS).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a text").alias("text")).write.parquet(f"{d}/documents.parquet")
    return str(d)


def _most_rows(spark, run):
    """What ``run`` returns, and the most rows that a node of a plan made meanwhile."""
    store, waits = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    waits.waitUntilEmpty(30_000)
    before, out, most = store.executionsCount(), run(), 0
    waits.waitUntilEmpty(30_000)
    made = store.executionsList()
    for i in range(before, made.size()):
        number = made.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for n in range(nodes.size()):
            metrics = nodes.apply(n).metrics()
            for m in range(metrics.size()):
                metric = metrics.apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return out, most


def _jobs(spark, run):
    """The number of jobs that ``run`` takes."""
    spark.sparkContext.setJobGroup(name := f"counted-{random.random()}", "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_price_series_takes_no_jobs_for_each_event(spark, folder):
    # fifteen events a thread
    assert _jobs(spark, lambda: catalog.queries()["price_series"](spark, folder).count()) < 15


def test_threads_in_order_keep_their_prices_apart(spark):
    events = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 3, 1), (None, 4, 1), (None, 5, 2)], "thread_id string, event_id long, event_no int")
    start = spark.createDataFrame([("b", 2.0)], "thread_id string, price double")
    step = lambda price, event: None if event["event_id"] == 2 else price + event["event_id"]
    got = {r["event_id"]: (r["thread_id"], r["price"], r["realised"]) for r in series.in_order(events, step, start).collect()}
    assert got == {2: ("a", 0.0, None), 1: ("a", 0.0, 1.0), 3: ("b", 2.0, 5.0), 4: (None, 0.0, 4.0), 5: (None, 4.0, 9.0)}


#: Queries over all pairs of these tables (450,000; 2,250,000 where a fourth of the rows ask); what they keep of each task is far less.
PAIRED = ["vec_knn_cosine", "detect_accept", "detect_ranks", "noise_floor", "ref_draw", "vec_best_per_message", "eval_stages", "density_shed", "lowest_surviving", "mmr_rank", "detect_spread", "select_prerequisites", "selection_report", "selected_walk", "index_knn", "index_search", "index_probed", "index_knn_thread", "vec_recall", "search_enriched", "search_topk", "vec_int8_rerank", "eval_recall"]


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_are_no_rows(spark, folder, name):
    _, most = _most_rows(spark, lambda: catalog.queries()[name](spark, folder).count())
    assert most < ROWS * (ROWS / 4 if name.startswith("select") else ASKING) / 4


def _cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in (*a, *b):
        return 0.0
    sizes = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 0.0 if sizes == 0 else round(sum(x * y for x, y in zip(a, b)) / sizes, 6)


@pytest.mark.parametrize("text", [False, True])
def test_closest_rows_of_odd_tables(spark, text):
    draw, nan = random.Random(3), float("nan")
    vectors = [[draw.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    vectors += [vectors[0]] * 20 + [None, [0.0] * 5, [1.0, 2.0], [1.0, None, 0.0, 0.0, 0.0], [], [1e200] * 5, [1e-170] * 5, [-x for x in vectors[0]]]
    name = (lambda k: f"m{k % 40}") if text else (lambda k: k % 40)
    rows = [(k, name(k), k % 3 if k % 7 else None, v) for k, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, f"vec_id long, message_id {'string' if text else 'long'}, label int, vector array<double>").repartition(3)
    asked = [(k, label, v) for k, _, label, v in rows if k % 3 == 0 or k >= 80]
    queries = spark.createDataFrame(asked, "query_id long, query_label int, query_vector array<double>")
    for k in (1, 4, 200):
        for same in (False, True):
            only = (F.col("label"), F.col("query_label")) if same else None
            got = retrieval.nearest(queries, table, k, gone=retrieval.itself(), same=only).collect()
            best = retrieval.closest(queries, table, k, of="message_id", tie="vec_id", gone=retrieval.itself(), same=only).collect()
            for q, label, v in asked:
                score = {i: _cosine(v, w) for i, _, own, w in rows if i != q and (not same or own == label is not None)}
                score = {i: math.inf if math.isnan(s) else s for i, s in score.items()}
                order = sorted(score, key=lambda i: (-score[i], i))[:k]
                mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
                assert [i for _, i, _ in mine] == order
                assert [s for _, _, s in mine] == pytest.approx([math.nan if score[i] == math.inf else score[i] for i in order], nan_ok=True)
                first: dict = {}
                for i in sorted(score, key=lambda i: (-score[i], i)):
                    first.setdefault(rows[i][1], i)
                order = sorted(first, key=lambda m: (-score[first[m]], m))[:k]
                mine = sorted((r["rank"], r["message_id"], r["vec_id"]) for r in best if r["query_id"] == q)
                assert [(m, i) for _, m, i in mine] == [(m, first[m]) for m in order]
    rows.append((900, name(1), 1, [nan] * 5))
    table = spark.createDataFrame(rows, table.schema)
    # what is no number sorts before all others, as in SQL
    assert {r["vec_id"] for r in retrieval.nearest(queries.filter("query_id < 9"), table, 1).collect()} == {900}
    assert retrieval.nearest(queries, table.limit(0), 3).count() == retrieval.nearest(queries.limit(0), table, 3).count() == 0


def test_draws_equal_the_formula(spark):
    rows = [(k, k * 977 - 3000, k % 4) for k in range(400)] + [(7, 7 * 977 - 3000, 3)]
    table = spark.createDataFrame(rows, "vec_id long, row_no long, message_id long").withColumn("thread_id", F.col("message_id").cast("string")).repartition(3)
    events = spark.createDataFrame([(1, 5, None), (2, 10**15, "2"), (3, 3000, None)], "event_id long, seed long, scope_thread string")
    gone = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "event_id long, message_id long")
    got = retrieval.draw(table, events, 50, gone, "message_id", scoped=True).collect()
    for event, seed, scope, without in ((1, 5, None, {0, 2}), (2, 10**15, "2", {1}), (3, 3000, None, set())):
        key = lambda no: (1 if no + seed >= 0 else -1) * (abs(no + seed) * 2654435761 % 2**32)  # noqa: B023, E731
        want = sorted((key(no), i) for i, no, m in rows if m not in without and scope in (None, str(m)))[:50]
        assert sorted((r["draw_key"], r["vec_id"]) for r in got if r["event_id"] == event) == want


def _odd(spark):
    draw = random.Random(4)
    vectors = [[draw.gauss(0, 1) for _ in range(70)] for _ in range(90)]
    vectors += [vectors[0]] * 15 + [None, [0.0] * 70, [1.0, 2.0], [1.0] * 100]
    rows = [(k, k % 40, k % 5, v) for k, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, message_id long, label int, vector array<double>").repartition(3)
    return table, table.filter("vec_id % 4 = 0 or vec_id > 100").selectExpr("vec_id as query_id", "vector as query_vector", "label as query_label")


def test_shortlists_equal_those_of_rows(spark):
    table, queries = _odd(spark)
    for k in (3, 50):
        rows = retrieval.two_stage(queries, table, 20)
        want = retrieval.best(rows, ["query_id"], [F.desc("score"), F.col("vec_id")], k, "rank").select("query_id", "vec_id", "score", "rank")
        got = retrieval.shortlisted(queries, table, k, 20)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        one = retrieval.best(rows, ["query_id", "message_id"], [F.desc("score"), F.col("vec_id")], 1, "first")
        want = retrieval.best(one, ["query_id"], [F.desc("score"), F.col("message_id")], k, "rank").select("query_id", "message_id", "vec_id", "score", "rank")
        got = retrieval.shortlisted(queries, table, k, 20, "message_id", "vec_id")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_ranks_equal_those_of_rows(spark):
    table, queries = _odd(spark)
    rows = retrieval.scored(queries, table, F.col("vec_id") != F.col("query_id"))
    want = telemetry.first_hits(rows.filter("label = query_label and label > 0"), rows)
    got = retrieval.first_ranks(queries.withColumn("query_label", F.expr("nullif(query_label, 0)")), table, (F.col("label"), F.col("query_label")), retrieval.itself())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

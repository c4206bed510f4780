"""Events of the selection queries ask with all chunks of their message."""

import random

from threadloom.plans import catalog

ASKING, FOUND = 23, 401


def _answers(spark, folder, name):
    """The query's rows over every fourth message, where chunk 3 of message 4 and chunk 1 of message 80 are alike."""
    draw = random.Random(5)
    rows = {k: [draw.gauss(0, 1) for _ in range(8)] for k in range(800) if k // 5 % 4 == 0}
    rows[FOUND] = rows[ASKING]
    spark.createDataFrame([(k, v, k % 7) for k, v in rows.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return catalog.queries()[name](spark, str(folder)).collect()


def test_later_chunks_of_an_event_find_prerequisites(spark, tmp_path):
    found = {(r["event_id"], r["from_id"]): r["cross_encoder_score"] for r in _answers(spark, tmp_path, "select_prerequisites")}
    assert found[4, 80] == 1.0


def test_report_counts_the_candidates_of_all_chunks(spark, tmp_path):
    report = {r["event_id"]: r["n_candidates"] for r in _answers(spark, tmp_path, "selection_report")}
    # one chunk has eight candidates
    assert report.keys() == set(range(0, 160, 4)) and min(report.values()) > 8


def test_walk_takes_edges_of_later_chunks(spark, tmp_path):
    walked = {(r["event_id"], r["id"]): r["score"] for r in _answers(spark, tmp_path, "selected_walk")}
    # the edge itself, not a longer way round
    assert walked[4, 80] == round(1 - 1 / 17, 6)

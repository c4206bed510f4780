"""Blocks of lines as packed entries, and edit distances within a limit."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.llm import edits, line_dedup

PARTS = 8


def made(texts):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text_hash", "text"])
    return pa.Table.from_batches(line_dedup._occurrences(5, PARTS)(iter([batch]))).to_pylist()


def test_blocks_of_all_lines_reach_the_shuffle_in_a_row_a_part():
    draw = random.Random(2)
    texts = ["\n".join(" ".join(draw.choice("abcdefgh") * draw.randrange(1, 9) for _ in range(20)) for _ in range(30)) for _ in range(40)]
    rows = made([*texts, texts[0]])
    packed = [r for r in rows if r["part"] is not None]
    assert len(packed) <= PARTS and sum(r["part"] is None for r in rows) == 41 * 30
    found = {tuple(e) for r in packed for e in np.frombuffer(r["entries"], np.int64).reshape(-1, 2).tolist()}
    x = line_dedup.signed_lines(texts, 5)
    lines = np.repeat(x["h"], np.diff(x["at"]))
    assert found == set(zip(x["keys"].view(np.int64).tolist(), lines.view(np.int64).tolist()))
    assert sum(r["n_blocks"] for r in rows if r["part"] is None) == len(lines)


def test_shared_blocks_are_those_of_different_lines():
    blobs = [np.array(x, np.int64).tobytes() for x in ([(5, 1), (7, 1), (-3, 1)], [(5, 2), (7, 1), (9, 4)], [(5, 1), (-3, 3), (5, 6)])]
    batches = [pa.record_batch([pa.array([b], pa.binary())], ["entries"]) for b in blobs]
    rows = pa.Table.from_batches(line_dedup._shared(iter(batches))).to_pylist()
    assert sorted((r["key"], r["h"], r["c"]) for r in rows) == [(-3, 1, 2), (-3, 3, 2), (5, 1, 3), (5, 2, 3), (5, 6, 3)]
    assert list(line_dedup._shared(iter([]))) == []
    alone = pa.record_batch([pa.array([np.array([(1, 2), (3, 2)], np.int64).tobytes()], pa.binary())], ["entries"])
    assert list(line_dedup._shared(iter([alone]))) == []


def test_entries_of_copies_in_several_tasks_are_one_line(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    other = line.replace("seven", "some")
    docs = spark.createDataFrame([(1, line), (2, line), (3, other), (4, line)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1}
    assert line_dedup.drop_repeated_lines(docs.filter(F.col("doc_id") == 3)).first()["n_dropped"] == 0


def test_distances_within_limits():
    draw = random.Random(7)
    a, b = [], []
    for n in (3, 40, 63, 64, 65, 128, 200, 350, 700) * 12:
        x = [draw.choice("abcdé ") for _ in range(n)]
        y = list(x)
        for _ in range(int(n * draw.choice((0.05, 0.19, 0.21, 0.6)))):
            k, kind = draw.randrange(len(y)), draw.randrange(3)
            y[k : k + (kind != 1)] = [] if kind == 2 and len(y) > 1 else [draw.choice("abcdfg")]
        if draw.random() < 0.2:
            y = y[n // 9 :] + y[: n // 9]
        a.append("".join(x))
        b.append("".join(y))
    true = np.array([edits.edit_distance(x, y) for x, y in zip(a, b)])
    limits = np.maximum([max(len(x), len(y)) // 5 for x, y in zip(a, b)], [abs(len(x) - len(y)) for x, y in zip(a, b)])
    found = edits.distances(a, b, limits)
    assert 20 < (true <= limits).sum() < len(a) - 20
    assert np.array_equal(found[true <= limits], true[true <= limits]) and (found[true > limits] > limits[true > limits]).all()

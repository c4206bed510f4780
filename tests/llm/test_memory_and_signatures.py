"""What the Python workers of the pipeline hold at once, and SimHashes of whole lines."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import line_dedup, packing
from threadloom.llm.queries import tokenizer_path


def test_stages_bound_the_bytes_of_a_batch(spark):
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"), F.lit("en").alias("lang"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
    try:
        dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
        most = docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    finally:
        spark.conf.set(key, before)
    # the row that reaches the bound is still in; all rows in one batch have five times as much
    assert 0 < most < 2 * corpus_pipeline.BATCH_BYTES


def test_packing_takes_a_large_batch_in_parts(monkeypatch):
    asked = []

    def encoder(path):
        return lambda texts: [asked.append(len(texts)) or b"\1\0\0\0" for _ in texts]

    taken = []
    to_parts = packing.small
    monkeypatch.setattr(packing, "small", lambda batches: (taken.append(b.nbytes) or b for b in to_parts(batches)))
    monkeypatch.setattr(packing, "encoder", encoder)
    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    batch = pa.record_batch([pa.array(range(1200), pa.int64()), pa.array(["x" * 9000] * 1200)], ["doc_id", "text"])
    out = list(packing._run(tokenizer_path(), 2, packing.TIERS, packing.BLOCK_TOKENS)(iter([batch])))
    assert len(taken) > 1 and max(taken) < 5 << 20
    assert {d for b in out for d in b.column(0).to_pylist()} == set(range(1200))


def test_simhash_of_lines_of_all_lengths_against_plain_counts():
    draw = random.Random(8)
    n = np.array([5, 254, 255, 256, 257, 480, 481, 3000])
    words = np.array([draw.getrandbits(64) for _ in range(n.sum())], np.uint64)
    first = np.cumsum(n) - n
    # place 8 * r + q of the result is bit 8 * q + r
    expected = [[2 * sum(int(w) >> (8 * q + r) & 1 for w in words[lo : lo + m].tolist()) > m for r in range(8) for q in range(8)] for lo, m in zip(first.tolist(), n.tolist())]
    found = line_dedup._line_votes(words, first, n)
    assert np.array_equal(np.unpackbits(found.view(np.uint8)).reshape(-1, 64), np.array(expected, np.uint8))


def test_lines_of_repeated_rows_are_written_once():
    wanted = [{"line_no": 1, "h": 7}, {"line_no": 0, "h": 9}]
    row = pa.struct([("line_no", pa.int32()), ("h", pa.int64())])
    batch = pa.record_batch([pa.array(["One, two\nTHREE"] * 3), pa.array([wanted] * 3, pa.list_(row))], ["text", "wanted"])
    out = pa.Table.from_batches(line_dedup._wanted_lines(iter([batch, batch]))).to_pylist()
    assert out == [{"id": 7, "line": "three"}, {"id": 9, "line": "one two"}]

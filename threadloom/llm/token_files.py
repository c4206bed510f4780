"""Token-id files with a shared zstandard dictionary and an offset index.

Each document's ids are compressed on their own, with one dictionary that was trained on a bounded
sample of serialized id arrays, so a short document can be read without its neighbours. Texts are
tokenised and compressed where they are read; only the frames are dealt by ranges of doc_id and
sorted. A shard file is

    magic (8 bytes), width of an id in bytes (uint32), SHA-256 of the dictionary (32 bytes),
    the frames, the index (doc_id int64, offset uint64, size uint64, n_tokens uint64 per
    document, a document without id having the lowest int64), then index offset, number of
    documents (both uint64) and the magic again.

Files go to a folder that all executors share; a shard is written under a name of its attempt and
then moved, so that a task that runs again replaces it whole.

Defined cases: a null or empty text is its end id alone; rows without doc_id come first; rows that
repeat a doc_id are neighbours, in the order of their frames; an empty table writes no shard; where
the sample is too small to train on, the dictionary is empty; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.arrays import slices
from threadloom.llm.ranges import LOWEST, range_of, shuffle_partitions
from threadloom.llm.tokens import encoder
from threadloom.llm.work import save

MAGIC = b"TLTOKEN1"
HEADER = len(MAGIC) + 4 + 32
FOOTER = 16 + len(MAGIC)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8")])
DICTIONARY_BYTES = 64 << 10
#: The dictionary's sample: about this many documents, and at most twice as many, this many ids of each.
SAMPLE_DOCS = 1000
SAMPLE_IDS = 2048
LEVEL = 3


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _encoded(path: str, end_id: int) -> Iterator:
    end = end_id.to_bytes(4, "little")

    def run(texts: list[str]) -> Iterator[np.ndarray]:
        for lo, hi in slices(texts):
            for ids in encoder(path)(texts[lo:hi]):
                yield np.frombuffer(ids + end, "<u4")

    return run


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> bytes:
    """A dictionary from a bounded sample, which is drawn by the hash of doc_id."""
    n = docs.select("doc_id").count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    picked = docs.filter(F.abs(F.xxhash64("doc_id") % 1_000_000) < int(share * 1_000_000) + 1).select("text").limit(2 * SAMPLE_DOCS)
    encode = _encoded(tokenizer, end_id)

    def run(batches):
        for batch in batches:
            ids = encode([t or "" for t in batch.column(0).to_pylist()])
            yield pa.record_batch([pa.array([x[:SAMPLE_IDS].astype(kind).tobytes() for x in ids], pa.binary())], ["ids"])

    samples = [bytes(r["ids"]) for r in picked.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int = 1 << 16) -> DataFrame:
    """Write the shards and the dictionary below ``folder``; returns the manifest.

    ``vocabulary`` bounds the ids and sets their width; a larger id is an error. The manifest ``(shard, path, n_docs,
    n_tokens, base)`` has one row per shard in the order of doc_id; ``base`` counts the ids of
    all shards before it. It is also kept as ``folder/manifest``.
    """
    spark, kind = docs.sparkSession, _width(vocabulary)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    raw = train_dictionary(docs, tokenizer, end_id, kind)
    digest = hashlib.sha256(raw).digest()
    _put(f"{folder}/dictionary.zstd", [raw])
    encode = _encoded(tokenizer, end_id)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, **_dictionary(raw))
        for batch in batches:
            sizes, made = [], []
            for ids in encode([t or "" for t in batch.column(1).to_pylist()]):
                if ids.max() > np.iinfo(kind).max:
                    raise ValueError(f"an id of {ids.max()} is outside a vocabulary of {vocabulary}")
                sizes.append(len(ids))
                made.append(press.compress(ids.astype(kind).tobytes()))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "shard", "n_tokens", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        shard, at, index = None, 0, []
        out = name = None

        def close():
            table = np.array(index, INDEX)
            out.write(table.tobytes() + np.array([at, len(index)], "<u8").tobytes() + MAGIC)
            out.close()
            final = f"{folder}/shard-{shard:08d}.tok"
            _move(name, final)
            done.append((shard, final, len(index), int(table["n_tokens"].sum())))

        for batch in batches:
            for doc_id, to, n, frame in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if to != shard:
                    if out is not None:
                        close()
                    shard, index, at = to, [], HEADER
                    name = f"{folder}/.{shard:08d}-{uuid.uuid4().hex}"
                    out = _open_out(name)
                    out.write(MAGIC + np.uint32(np.dtype(kind).itemsize).tobytes() + digest)
                out.write(frame)
                index.append((LOWEST if doc_id is None else doc_id, at, len(frame), n))
                at += len(frame)
        if out is not None:
            close()
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "n_docs", "n_tokens"])

    n = shuffle_partitions(docs)
    dealt = docs.withColumn("shard", range_of(docs, F.col("doc_id"), n).cast("long"))
    pressed = dealt.mapInArrow(frames, "doc_id long, shard long, n_tokens long, frame binary").select("doc_id", "shard", "n_tokens", "frame")
    ordered = pressed.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "frame")
    made = save(ordered.mapInArrow(shards, "shard long, path string, n_docs long, n_tokens long"))
    rows, base = [], 0
    for r in sorted(made.collect()):
        rows.append((*r, base))
        base += r["n_tokens"]
    manifest = spark.createDataFrame(rows, "shard long, path string, n_docs long, n_tokens long, base long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files.

    ``ids`` are little-endian unsigned 32-bit integers. Shards are read one to a task, frame after
    frame; a shard of another dictionary is an error.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _get(f"{folder}/dictionary.zstd")
        undo = zstandard.ZstdDecompressor(**_dictionary(raw))
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open_in(path) as f:
                    kind, index = _index(f, raw)
                    start = base + np.cumsum(index["n_tokens"].astype("<i8")) - index["n_tokens"].astype("<i8")
                    f.seek(HEADER)
                    for lo in range(0, len(index), 500):
                        part = index[lo : lo + 500]
                        ids = [np.frombuffer(undo.decompress(f.read(int(s))), kind).astype("<u4").tobytes() for s in part["size"]]
                        keys = part["doc_id"]
                        yield pa.record_batch([pa.array(keys, mask=keys == LOWEST), pa.array(start[lo : lo + 500]), pa.array(part["n_tokens"].astype("<i8")), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    spread = manifest.repartition(max(1, min(manifest.count(), 10_000)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(folder: str, shard: str, doc_id: int) -> list[list[int]]:
    """The ids of one document of a shard, through its index: a list for each row of that id."""
    raw = _get(f"{folder}/dictionary.zstd")
    undo = zstandard.ZstdDecompressor(**_dictionary(raw))
    with _open_in(shard) as f:
        kind, index = _index(f, raw)
        lo, hi = np.searchsorted(index["doc_id"], [doc_id, doc_id + 1])
        found = []
        for row in index[lo:hi]:
            f.seek(int(row["offset"]))
            found.append(np.frombuffer(undo.decompress(f.read(int(row["size"]))), kind).tolist())
    return found


def _index(f, raw: bytes) -> tuple[str, np.ndarray]:
    head = f.read(HEADER)
    f.seek(f.size() - FOOTER)
    foot = f.read(FOOTER)
    if head[:8] != MAGIC or foot[16:] != MAGIC:
        raise ValueError("not a token file, or cut short")
    if head[12:] != hashlib.sha256(raw).digest():
        raise ValueError("the file was written with another dictionary")
    at, n = np.frombuffer(foot[:16], "<u8")
    f.seek(int(at))
    return f"<u{int.from_bytes(head[8:12], 'little')}", np.frombuffer(f.read(int(n) * INDEX.itemsize), INDEX)


def _open_out(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def _open_in(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _move(uri: str, to: str) -> None:
    system, path = pafs.FileSystem.from_uri(uri)
    system.move(path, pafs.FileSystem.from_uri(to)[1])


def _put(uri: str, parts: list[bytes]) -> None:
    name = f"{uri}.{uuid.uuid4().hex}"
    with _open_out(name) as out:
        for part in parts:
            out.write(part)
    _move(name, uri)


def _get(uri: str) -> bytes:
    with _open_in(uri) as f:
        return f.read()


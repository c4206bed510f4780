"""Hierarchical multi-length packing of tokenised documents.

Every document is cut into full windows of the longest context size and a rest, which is routed
to the smallest tier that holds it. Tiers are packed from the longest down: a window opens with
the longest waiting piece of its tier, its gap takes the longest shorter pieces that fit, and the
last of them is cut so that the window is exactly full. What the end of a partition leaves open is
cut into sequences whose lengths are powers of two, which need no padding. The sequences of each
block are dealt tier by tier over step groups, so that groups carry nearly the same tokens;
``even_groups`` deals those of all partitions over common groups.

Partitions are packed on their own, in blocks of bounded size: there is no shuffle, and no row
passes the driver.

Defined cases: a null or empty text is its end id alone; rows without or with a repeated doc_id
are packed like any other, one row of pieces each; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.arrays import slices, small
from threadloom.llm.tokens import encoder
from threadloom.llm.work import give_back, save

TIERS = (512, 1024, 2048, 4096)
BLOCK_TOKENS = 1_000_000
STEP_TOKENS = 16 * 4096
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long, length_no long"


class _Waiting:
    """Pieces ``(length, serial, piece)`` in order of length."""

    def __init__(self):
        self.items: list[tuple] = []
        self._serial = 0

    def add(self, piece: tuple) -> None:
        self._serial += 1
        insort(self.items, (piece[2], self._serial, piece))

    def longest(self, most: int):
        """Take the longest piece of at most ``most`` tokens."""
        at = bisect_right(self.items, (most, float("inf")))
        return self.items.pop(at - 1)[2] if at else None

    def shortest(self):
        return self.items.pop(0)[2] if self.items else None


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    row, start, length, ids, total = piece
    return (row, start, n, ids[: 4 * n], total), (row, start + n, length - n, ids[4 * n :], total)


class Packer:
    """Packs pieces ``(doc_id, start, length, ids, doc_tokens)`` into sequences."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        self.most = self.tiers[-1]
        self.waiting = _Waiting()
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> list[list[tuple]]:
        """Take a document; returns its full windows."""
        total, full = len(ids) // 4, []
        for start in range(0, total, self.most):
            part = ids[4 * start : 4 * (start + self.most)]
            piece = (doc_id, start, len(part) // 4, part, total)
            if piece[2] == self.most:
                full.append([piece])
            else:
                self.waiting.add(piece)
                self.tokens += piece[2]
        return full

    def pack(self) -> list[list[tuple]]:
        """Full windows of all tiers; pieces that fill no window keep waiting."""
        done = []
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while self.tokens >= tier:
                first = self.waiting.longest(tier)
                if first is None:
                    break
                if first[2] <= below:  # a tier's pieces are longer than the tier below it
                    self.waiting.add(first)
                    break
                done.append(self._window(first, tier))
        return done

    def _window(self, first: tuple, size: int) -> list[tuple]:
        window, gap = [first], size - first[2]
        while gap:
            piece = self.waiting.longest(gap)
            if piece is None:
                piece, rest = _cut(self.waiting.shortest(), gap)
                self.waiting.add(rest)
            window.append(piece)
            gap -= piece[2]
        self.tokens -= size
        return window

    def finish(self) -> list[list[tuple]]:
        """All that still waits, in sequences whose lengths are powers of two."""
        done = self.pack()
        while self.tokens:
            size = min(1 << (self.tokens.bit_length() - 1), self.most)
            first = self.waiting.longest(size)
            if first is None:
                first, rest = _cut(self.waiting.shortest(), size)
                self.waiting.add(rest)
            done.append(self._window(first, size))
        return done


def step_groups(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: those of one length are dealt round and round, there and back."""
    n = max(1, round(sum(lengths) / step_tokens))
    groups, turn = [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        lap, at = divmod(turn, n)
        groups[k] = at if lap % 2 == 0 else n - 1 - at
        turn += 1
    return groups


def _run(path: str, end_id: int, tiers: tuple[int, ...], block_tokens: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode, packer = encoder(path), Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        made = groups = pending = 0
        ready: list[list[tuple]] = []
        of_length: Counter[int] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, groups, ready, pending
            sizes = [sum(p[2] for p in s) for s in ready]
            steps = step_groups(sizes)
            cols: list[list] = [[] for _ in range(10)]
            for k, sequence in enumerate(ready):
                at = 0
                for doc_id, start, length, ids, total in sequence:
                    row = (doc_id, start, length, ids, total, base + made + k, at, sizes[k], base + groups + steps[k], of_length[sizes[k]])
                    for c, v in zip(cols, row):
                        c.append(v)
                    at += length
                of_length[sizes[k]] += 1
            if cols[0]:
                kinds = [pa.binary() if k == 3 else pa.int64() for k in range(10)]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names)
            made, groups, ready, pending = made + len(ready), groups + max(steps, default=-1) + 1, [], 0

        for batch in small(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                for doc_id, found in zip(ids[lo:hi], encode(texts[lo:hi])):
                    pending += len(found) // 4 + 1
                    ready += packer.add(doc_id, found + end)
                if pending >= block_tokens:
                    ready += packer.pack()
                    yield from flush()
        ready += packer.finish()
        yield from flush()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of every document: where it came from, its ids, and where it lies.

    ``ids`` are little-endian unsigned 32-bit integers; ``sequence_tokens`` is the sequence's
    length, a full window of a tier or another power of two.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_run(tokenizer, end_id, tuple(tiers), block_tokens), SCHEMA)


def even_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``pieces`` of ``pack``, as a written table, with ``step_group`` dealt over the whole output.

    Sequences of one length are numbered through all partitions, the longest lengths first, and
    dealt there and back over the groups, so any two groups differ by one longest sequence at
    most. Only counts by partition and length are gathered; the driver sees a row for each length
    (tiers and powers of two). An empty table stays empty.
    """
    part = F.shiftright("sequence_id", 40)
    first = pieces.filter(F.col("offset") == 0).select(part.alias("part"), "sequence_tokens")
    counts = save(first.groupBy("part", "sequence_tokens").agg(F.count("*").alias("c")))
    lengths = sorted(((r["sequence_tokens"], r["c"]) for r in counts.groupBy("sequence_tokens").agg(F.sum("c").alias("c")).collect()), reverse=True)
    groups = max(1, round(sum(n * c for n, c in lengths) / step_tokens))
    longer, before = F.lit(0), 0
    for n, c in lengths:
        longer, before = F.when(F.col("sequence_tokens") == n, before).otherwise(longer), before + c
    parts = Window.partitionBy("sequence_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(counts.select("part", "sequence_tokens", (longer + F.coalesce(F.sum("c").over(parts), F.lit(0))).alias("_before")))
    rows = pieces.withColumn("part", part).join(offsets, ["part", "sequence_tokens"])
    turn = F.col("_before") + F.col("length_no")
    at, lap = turn % groups, F.floor(turn / groups)
    return rows.withColumn("step_group", F.when(lap % 2 == 0, at).otherwise(groups - 1 - at)).select(pieces.columns)

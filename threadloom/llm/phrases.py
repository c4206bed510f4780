"""Phrase collocations of each language, mined from whole texts.

Runs of one to ``max_words`` words inside a piece of text become rows of language, phrase and
count, added up by hash aggregation: first single words, then pairs, then the longer ones. A run
can only be frequent if all runs inside it are, so pairs are made of frequent words and longer runs
of frequent pairs; no candidate is lost. What is frequent reaches the tasks as a bitmap of fixed
size, which may let rare runs through (their counts are dropped later) but holds back no frequent
one. Every candidate is cut after each of its words, both parts are joined with their counts, and
the lowest score counts, in decimals. A candidate goes where a phrase of one word more is as
frequent; longer phrases need no look, for the ones between them are as frequent then.

Defined cases: a null text has no words and a null language is ``und``; documents that repeat an
id count each; the id is not used; a row's extra columns are ignored; an empty table gives an
empty table. Phrases of equal score and count are ordered by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.arrays import slices
from threadloom.llm.ranges import shuffle_partitions
from threadloom.llm.work import save, scratch

UNKNOWN = "und"
#: Bits of the bitmap of what is frequent: 8 MiB whatever the corpus.
BITMAP_BITS = 26
_BUCKET = 1 << 15
_COUNTS = "lang string, phrase string, n long"
_SLICE = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[0x20, 0x09]] = True


class _Slice:
    """The words of some texts: a dictionary of strings, each word's number in it, its piece and language."""

    def __init__(self, texts: list[str], langs: list[str]):
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        inside = ~_ENDS_WORD[raw]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        wide = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOWER[raw[inside]]))
        coded = wide.dictionary_encode()
        self.strings = coded.dictionary
        self.word = coded.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(_ENDS_PIECE[raw])[starts]
        self.langs = sorted(set(langs))
        place = {x: k for k, x in enumerate(self.langs)}
        text_ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
        self.lang = np.array([place[x] for x in langs])[np.searchsorted(text_ends, starts, side="right")]

    def runs(self, size: int, shorter: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs of ``size`` words where ``open_``: a place of each, its count, and every word's run number or -1.

        ``shorter`` numbers the runs of one word fewer that begin at each word.
        """
        n = len(self.word) - size + 1
        numbers = np.full(len(self.word), -1)
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), numbers
        places = np.flatnonzero(open_[:n] & (self.piece[:n] == self.piece[size - 1 :]))
        key = shorter[places] * (len(self.strings) + 1) + self.word[places + size - 1]
        _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        numbers[places] = inverse
        return places[first], counts, numbers

    def singles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = self.lang * (len(self.strings) + 1) + self.word
        _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return first, counts, inverse

    def phrases(self, places: np.ndarray, size: int) -> pa.Array:
        words = [self.strings.take(pa.array(self.word[places + k])) for k in range(size)]
        return words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))

    def rows(self, places: np.ndarray, counts: np.ndarray, size: int) -> pa.RecordBatch:
        langs = pa.array(self.langs, pa.string()).take(pa.array(self.lang[places]))
        return pa.record_batch([langs, self.phrases(places, size).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

    def known(self, places: np.ndarray, size: int, bitmap: np.ndarray) -> np.ndarray:
        """Whether the bitmap has the runs at these places."""
        seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs]
        own = [seeds[k] for k in self.lang[places]]
        hashes = map(xxhash.xxh64_intdigest, self.phrases(places, size).cast(pa.large_binary()).to_pylist(), own)
        bits = np.fromiter(hashes, np.uint64, len(places)) & np.uint64((1 << BITMAP_BITS) - 1)
        return (bitmap[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices(texts, _SLICE):
            found = _Slice(texts[lo:hi], langs[lo:hi])
            if len(found.word):
                yield found


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _in_slices(batches):
        places, counts, _ = own.singles()
        yield own.rows(places, counts, 1)


def _pairs(words_bitmap) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(words_bitmap.value, np.uint8)
        for own in _in_slices(batches):
            first, _, number = own.singles()
            open_ = own.known(first, 1, bitmap)[number]
            places, counts, _ = own.runs(2, number, open_ & np.append(open_[1:], False))
            yield own.rows(places, counts, 2)

    return run


def _longer(words_bitmap, pairs_bitmap, max_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = (np.frombuffer(x.value, np.uint8) for x in (words_bitmap, pairs_bitmap))
        for own in _in_slices(batches):
            first, _, number = own.singles()
            open_ = own.known(first, 1, words)[number]
            places, _, number = own.runs(2, number, open_ & np.append(open_[1:], False))
            pair_known = np.append(own.known(places, 2, pairs), False)
            pair_open = pair_known[number]
            open_ = pair_open
            for size in range(3, max_words + 1):
                open_ = open_ & np.append(pair_open[size - 2 :], np.zeros(size - 2, bool))[: len(open_)]
                places, counts, number = own.runs(size, number, open_)
                open_ = number >= 0
                if not len(places):
                    break
                yield own.rows(places, counts, size)

    return run


def _bitmap(frequent: DataFrame) -> bytes:
    """One bit of each phrase's hash, as bytes of a fixed number."""
    bit = F.xxhash64("lang", "phrase").bitwiseAND((1 << BITMAP_BITS) - 1) + 1
    parts = frequent.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = bytearray((1 << BITMAP_BITS) // 8)
    for row in parts.collect():
        at = (row["b"] - 1) * (_BUCKET // 8)
        out[at : at + _BUCKET // 8] = row["bits"]
    return bytes(out)


def phrase_counts(docs: DataFrame, max_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Counts ``lang, phrase, n`` of all runs that occur ``least`` times and more, and each language's words ``lang, n``."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def counted(part: Callable) -> DataFrame:
        return texts.mapInArrow(part, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))

    with scratch() as kept:
        words = save(counted(_words))
        total = save(words.groupBy("lang").agg(F.sum("n").alias("n")))
        frequent = words.filter(F.col("n") >= least)
        words_bitmap = context.broadcast(_bitmap(frequent))
        pairs = save(counted(_pairs(words_bitmap)).filter(F.col("n") >= least))
        pairs_bitmap = context.broadcast(_bitmap(pairs))
        longer = counted(_longer(words_bitmap, pairs_bitmap, max_words)).filter(F.col("n") >= least)
        found = save(frequent.unionByName(pairs).unionByName(longer) if max_words > 2 else frequent.unionByName(pairs))
        kept += [found, total]
    return found, total


def collocations(docs: DataFrame, max_words: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs (lang, text)``. A candidate has 2 to ``max_words`` words and occurs ``a >= least`` times;
    it goes where a longer candidate that holds it has ``percent`` % of its count or more. The
    score is floor(1000 * a * n / (l * r)) of its lowest cut.
    """
    with scratch() as kept:
        counts, total = phrase_counts(docs, max_words, least)
        many = counts.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
        candidates = many.select("lang", "phrase", "words", F.col("n").alias("a"))
        cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
        part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
        cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
        cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        cut = cut.join(total, "lang").withColumns({"above": wide("a") * wide("n") * 1000, "below": wide("l") * wide("r")})
        cut = cut.withColumn("score", F.expr("above div below"))
        lowest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        inner = [F.array_join(F.slice("words", at, F.size("words") - 1), " ") for at in (1, 2)]
        longer = candidates.filter(F.size("words") > 2).select("lang", F.col("a").alias("longer_a"), F.explode(F.array(*inner)).alias("phrase"))
        held = lowest.alias("c").join(longer.alias("x"), (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & (F.col("x.longer_a") * 100 >= F.col("c.a") * percent), "left_anti")
        rows = held.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        order = [F.desc("score"), F.desc("a"), F.col("phrase")]
        # a language may hold most phrases: the best of each part of it meet in one task, not all
        salted = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs))))
        best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        out = save(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
        kept.append(out)
    return out

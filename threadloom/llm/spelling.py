"""Spelling variants of a corpus's words, grouped under their commonest neighbours.

Two words are near if one inserted, deleted or replaced letter makes one of the other. Candidates
come from rare letter pairs: the pairs of all words are ordered by how many words have them, and of
two near words the three rarest pairs of each have one in common that the edit does not touch, at
the same place from the start (edit behind it) or from the end (edit before it). What is left on
the side of the edit is cut into stretches of two letters; the edit lies in one of them and the
rest is equal, so the joined key stands for the letters before and behind that stretch. Words whose
keys meet must differ by one letter in the stretch, and pairs that do are verified as a whole.

Defined cases: a null text has no words; documents that repeat an id count each; a document
without id has the id ``null`` in the checksum that deletes letters; words of one count and length
are ordered by code points; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrays import slices
from threadloom.llm.work import free, save, scratch

RAREST, STRETCH = 3, 2
#: One word of so many of a document loses a letter (see ``word_counts``).
SPOILT = 31
_SLICE = 4_000_000
_BASE, _MASK = 0x9E3779B97F4A7C15, 2**64 - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def _letter_runs(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF: distinct ones, lower-cased in ASCII, and each run's number and text.

    In UTF-8 those letters beyond ASCII are all characters that begin with the byte C3.
    """
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join([*blobs, b""]), dtype=np.uint8)
    inside = _LETTER[raw]
    inside[1:] |= raw[:-1] == 0xC3
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[raw[inside]])]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(np.cumsum([len(b) + 1 for b in blobs]), starts, side="right")


def _counted(shortest: int, spoilt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts, _SLICE):
                known, number, text = _letter_runs(texts[lo:hi])
                if not len(number):
                    continue
                words = known.to_pylist()
                key, count = np.unique(text * len(words) + number, return_counts=True)
                text, number = np.divmod(key, len(words))
                bounds = np.searchsorted(text, np.arange(hi - lo + 1))
                sums = np.empty(len(key), np.uint32)
                for k in range(hi - lo):
                    a, b = bounds[k], bounds[k + 1]
                    seed = zlib.crc32(f"{ids[lo + k]}:".encode())
                    sums[a:b] = [zlib.crc32(words[w], seed) for w in number[a:b].tolist()]
                lose = sums % spoilt == 0
                whole = np.bincount(number[~lose], count[~lose], minlength=len(words)).astype(np.int64)
                other: dict[str, int] = {}
                for w, h, n in zip(number[lose].tolist(), sums[lose].tolist(), count[lose].tolist()):
                    word = words[w].decode()
                    place = h % len(word)
                    word = word[:place] + word[place + 1 :]
                    if len(word) >= shortest:
                        other[word] = other.get(word, 0) + n
                strings = known.cast(pa.large_string())
                keep = np.flatnonzero((whole > 0) & (pc.utf8_length(strings).to_numpy() >= shortest))
                yield pa.record_batch([strings.take(pa.array(keep)).cast(pa.string()), pa.array(whole[keep])], ["word", "n"])
                if other:
                    yield pa.record_batch([pa.array(list(other), pa.string()), pa.array(list(other.values()), pa.int64())], ["word", "n"])

    return run


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, spoilt: int = SPOILT) -> DataFrame:
    """Words ``word, n`` of ``docs (doc_id, text)`` with ``shortest`` letters and ``least`` occurrences or more.

    A run whose crc32, taken of ``<doc_id>:<run>``, divides by ``spoilt`` loses the letter at that
    number modulo its length.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_counted(shortest, spoilt), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least)


def _keys(word: str, rarest: list[int], shortest: int) -> Iterator[tuple[int, bool, str]]:
    """Key, whether it is for partners of one letter less, and the stretch that the key leaves out."""
    size = len(word)
    front = list(accumulate(map(ord, word), lambda h, c: (h * _BASE + c) & _MASK, initial=0))
    back = list(accumulate(map(ord, reversed(word)), lambda h, c: (h * _BASE + c) & _MASK, initial=0))
    for least in (size, size - 1):
        if least < shortest:
            continue
        seen = set()
        for place in rarest:
            for head, tail in ((min(place + 2, least), 0), (0, min(size - place, least))):
                side = least - head - tail
                parts = max(1, -(-side // STRETCH))
                seen |= {(head, tail, head + side * k // parts, tail + side - side * (k + 1) // parts) for k in range(parts)}
        for head, tail, before, behind in seen:
            key = xxhash.xxh64_intdigest(b"%d:%d:%d:%d:%d:%d:%d" % (least, head, tail, before, behind, front[before], back[behind]))
            yield key, least < size, word[before : size - behind]


def _keyed(ranks, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                found, owner = [], []
                for k, word in enumerate(part.column(1).to_pylist()):
                    rarest = sorted(range(len(word) - 1), key=lambda i: (rank[word[i : i + 2]], i))[:RAREST]
                    found += _keys(word, rarest, shortest)
                    owner += [k] * (len(found) - len(owner))
                keys, longer, stretch = zip(*found)
                yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(longer), pa.array(stretch, pa.string()), part.column(0).take(pa.array(owner))], ["key", "longer", "stretch", "id"])

    return run


def near_words(words: DataFrame, shortest: int = 7) -> DataFrame:
    """All pairs ``word, n, other, other_n`` of ``words (word, n)`` that differ by one letter, each in both directions.

    ``words`` are those of ``word_counts``, with ``shortest`` letters or more, six at least. Keys
    carry a digest of 128 bits in place of the word, so that long words are not repeated with each.
    """
    if shortest < RAREST + 3:
        raise ValueError("shorter words have too few letter pairs for the three rarest to tell")
    words = words.select(F.unhex(F.md5("word")).alias("id"), "word", "n")
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    # the letters of a word are 90 at most, so the driver gets 8,100 rows at most
    often = words.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("held")).orderBy("held", "pair").collect()
    ranks = words.sparkSession.sparkContext.broadcast({row["pair"]: k for k, row in enumerate(often)})
    keyed = words.select("id", "word").mapInArrow(_keyed(ranks, shortest), "key long, longer boolean, stretch string, id binary")
    a, b = keyed.alias("a"), keyed.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & ~(F.col("a.longer") & F.col("b.longer"))
    near = a.join(b, meet & (F.levenshtein("a.stretch", "b.stretch") == 1)).select(F.col("a.id").alias("id"), F.col("b.id").alias("other_id")).distinct()
    near = near.join(words, "id").join(words.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n")), "other_id")
    near = near.filter(F.levenshtein("word", "other", 1) == 1)
    turned = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return near.select(F.explode(turned).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """The last form that following ``word, form`` leads to, as ``word, root``; each round doubles the steps taken."""
    now = save(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = save(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = after.filter("moved").limit(1).count()
        free(now)
        now = after
        if not moved:
            return now.select("word", "root")


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, spoilt: int = SPOILT) -> DataFrame:
    """Every word with its form and root: ``word, form, root, n, n_near, form_n``.

    A word's form is its commonest near word (ties: the first in code-point order), if that is
    ``ratio`` times as common; else null. Its root is where its form's forms end.
    """
    with scratch() as kept:
        words = save(word_counts(docs, shortest, least, spoilt))
        near = near_words(words, shortest).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
        fits = -F.col("best.less") >= F.col("n") * ratio
        rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
        rows = save(rows)
        roots = _roots(rows.filter("form is not null"))
        out = save(rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
        kept.append(out)
    return out

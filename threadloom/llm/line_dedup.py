"""Fuzzy line deduplication across documents.

Lines are normalised (lower case, everything but letters and digits is a space). A SimHash of the
words is computed for every piece of a line: pieces begin at words whose hash is smaller than
those around it, so an edit changes the pieces next to it and no others. Each piece's SimHash is
one pigeonhole block and a join key; lines of up to ``HALVED`` and ``THIRDED`` words have blocks of
their halves and thirds too. A SimHash of 128 bits of the whole line, the sum of its pieces, bounds
candidates by Hamming distance inside the join. Edit similarity of the normalised lines decides.
Of every connected group one occurrence stays, the first by (doc_id, text hash, line number).

Candidates share several blocks: two where a line has up to ``THIRDED`` words, else one in
``SHARE`` of all. So each shares one of its rarest blocks, and only those are joined on: common
phrases, or a passage that many long lines quote, don't bring all of these together. Which links
the blocks lose is measured in the README. Texts are read once more, for lines that share a block.
Most blocks belong to one line alone: (block, line) entries are shuffled packed, many to a row, and
become rows only where lines share the block.

Defined cases: lines with fewer than ``min_words`` words always stay; so do line breaks of kept
lines; null and empty texts come back as they are; a document may lose all lines and then is the
empty text; rows that repeat doc_id and text count as one document and are treated alike; rows
without doc_id are documents of their own, first in order; an empty table gives an empty table;
extra columns are kept, whatever their names (but ``n_dropped`` is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrays import hashed_runs, mix, slices
from threadloom.llm.edits import all_similar
from threadloom.llm.linking import link_buckets
from threadloom.llm.work import save, scratch

MIN_WORDS = 5
SIMILARITY_PERCENT = 80
#: Words up to which a line has blocks of its halves and thirds.
HALVED, THIRDED = 12, 24
#: One of so many blocks at least is shared by candidates longer than that.
SHARE = 5
#: Words of the shorter line, from which on candidates differ in so many of 128 SimHash bits at most.
MAX_BITS = ((61, 24), (25, 28), (0, 36))
#: Members of a bucket that all others meet before all pairs between its parts are tried.
PIVOTS = 16
#: Words of a piece at most, so that the votes on a bit fit in a byte.
LONGEST_PIECE = 240
#: Blocks that a task holds before it passes them on.
HELD = 1_000_000
_NAMES = ["doc_id", "text_hash", "line_no", "h", "words", "chars", "n_blocks", "sig", "sig2", "part", "entries"]
_LINE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
_LANES = np.uint64(0x0101010101010101)
_ASCII_GAPS = bytes(c if c == 10 or chr(c).isalnum() or c > 127 else 32 for c in range(256))
_GAP = re.compile(r"[\W_]+")
_PLACES = np.uint64(0x9E3779B97F4A7C15)
_FAMILIES = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, 3, dtype=np.uint64)


def normalise(line: str) -> str:
    return _GAP.sub(" ", line.lower()).strip()


def _cleared(text: str) -> bytes:
    """The text in lower case with spaces for all that is no letter, digit or line break."""
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalnum():
                text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_ASCII_GAPS)


def _lowest(words: np.ndarray, line: np.ndarray, reach: int) -> np.ndarray:
    """Whether a word's hash is smaller than those of the ``reach`` words on either side in its line."""
    low = np.ones(len(words), bool)
    for d in range(1, reach + 1):
        if d >= len(words):
            break
        same = line[d:] == line[:-d]
        low[d:] &= ~same | (words[d:] < words[:-d])
        low[:-d] &= ~same | (words[:-d] <= words[d:])
    return low


def _votes(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit SimHash from each row of bit sums: the bits that more than half of the words have."""
    return np.packbits(sums > (counts // 2).astype(sums.dtype)[:, None], axis=1).view(np.uint64).ravel()


def _bit_sums(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words of each run have each bit, 64 counts a row; runs have fewer than 256 words.

    Eight bits at a time are added up in the bytes of one integer.
    """
    lanes = [np.add.reduceat((words >> np.uint64(k)) & _LANES, starts) for k in range(8)]
    return np.stack(lanes, axis=1).view(np.uint8)


def _line_votes(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of whole lines; those of more words than a byte counts are summed up by parts."""
    out = _votes(_bit_sums(words, first), np.minimum(n, 255))
    for k in np.flatnonzero(n > 255).tolist():
        own = words[first[k] : first[k] + n[k]]
        sums = _bit_sums(own, np.arange(0, len(own), LONGEST_PIECE)).sum(axis=0, dtype=np.int64)
        out[k] = _votes(sums[None], n[k : k + 1])[0]
    return out


def _blocks(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of every line, and (line, block key) of its pieces.

    ``words``: the word hashes of all lines; ``first``: where each line's begin; ``n``: how many.
    """
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - first[line]
    rest = n[line] - place
    lines, keys = [], []

    def add(words: np.ndarray, line: np.ndarray, cut: np.ndarray, family: int) -> None:
        starts = np.flatnonzero(cut)
        counts = np.diff(starts, append=len(words))
        lines.append(line[starts])
        keys.append(mix(_votes(_bit_sums(words, starts), counts) + counts.astype(np.uint64) * _PLACES + _FAMILIES[family]))

    cut = (place % LONGEST_PIECE == 0) | (_lowest(words, line, 2) & (place >= 3) & (rest >= 3))
    add(words, line, cut, 0)
    simhash = np.stack([_line_votes(x, first, n) for x in (words, mix(words ^ _PLACES))], axis=1)
    for family, (parts, most) in enumerate(((2, HALVED), (3, THIRDED)), 1):
        short = np.flatnonzero(n[line] <= most)
        if len(short):
            bounds = [place[short] == n[line[short]] * j // parts for j in range(parts)]
            add(words[short], line[short], np.logical_or.reduce(bounds), family)
    return simhash, np.concatenate(lines), np.concatenate(keys)


def signed_lines(texts: list[str], min_words: int) -> dict[str, np.ndarray]:
    """Of all long enough lines: text ``row`` and line ``no``, hash ``h``, ``words``, ``chars``, both halves of ``sig`` and blocks.

    ``blocks`` of the line k are ``keys[at[k] : at[k + 1]]``, sorted and distinct.
    """
    blobs = [_cleared(t) for t in texts]
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    breaks = np.flatnonzero(raw == 10)
    words, starts, ends = hashed_runs(raw, raw > 32)
    ends_of_text = np.cumsum([len(b) + 1 for b in blobs]) - 1
    row = np.searchsorted(ends_of_text, breaks)
    first_break = np.searchsorted(breaks, np.append(0, ends_of_text[:-1] + 1))
    line = np.searchsorted(breaks, starts)
    n = np.bincount(line, minlength=len(breaks))
    wide = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = wide[ends] - wide[starts]
    good = np.flatnonzero(n >= min_words)
    kept = n[line] >= min_words
    words, chars, n = words[kept], chars[kept], n[good]
    first = np.cumsum(n) - n
    out = {"row": row[good], "no": good - first_break[row[good]], "words": n}
    if not len(n):
        return out | {"h": np.zeros(0, np.uint64), "keys": np.zeros(0, np.uint64), "sig": np.zeros((0, 2), np.uint64), "chars": n, "at": np.zeros(1, np.int64)}
    place = (np.arange(len(words)) - np.repeat(first, n)).astype(np.uint64)
    out["h"] = mix(np.add.reduceat(mix(words + (place + np.uint64(1)) * _PLACES), first) + n.astype(np.uint64))
    out["chars"] = np.add.reduceat(chars, first) + n - 1
    sigs, lines, keys, lo = [], [], [], 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + 100_000)))
        sig, at, key = _blocks(words[first[lo] : first[hi - 1] + n[hi - 1]], first[lo:hi] - first[lo], n[lo:hi])
        sigs.append(sig)
        lines.append(at + lo)
        keys.append(key)
        lo = hi
    line, key = np.concatenate(lines), np.concatenate(keys)
    order = np.lexsort((key, line))
    line, key = line[order], key[order]
    fresh = np.append(True, (line[1:] != line[:-1]) | (key[1:] != key[:-1]))
    line, out["keys"], out["sig"] = line[fresh], key[fresh], np.concatenate(sigs)
    out["at"] = np.searchsorted(line, np.arange(len(n) + 1))
    return out


def _entries(keys: list[np.ndarray], lines: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """(block key, line) packed into one row for each part of the keys that has any."""
    both = np.stack([np.concatenate(keys), np.concatenate(lines)], axis=1)
    part = (both[:, 0] % np.uint64(parts)).astype(np.uint16)
    both = both[np.argsort(part, kind="stable")]
    at = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
    own = np.flatnonzero(np.diff(at))
    blobs = [both[at[k] : at[k + 1]].tobytes() for k in own.tolist()]
    empty = [pa.nulls(len(own), t) for t in _LINE_TYPES]
    return pa.record_batch([*empty, pa.array(own.astype(np.int32)), pa.array(blobs, pa.binary())], _NAMES)


def _occurrences(min_words: int, parts: int):
    """Every long enough line, and in rows of their own its blocks, where the task has not just seen an equal line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held_keys, held_lines, held = [], [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in slices(texts):
                x = signed_lines(texts[lo:hi], min_words)
                if not len(x["row"]):
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                before = len(seen)
                fresh = np.zeros(len(x["h"]), bool)
                for k, h in enumerate(x["h"].tolist()):
                    seen.add(h)
                    fresh[k] = len(seen) > before
                    before = len(seen)
                sizes = np.diff(x["at"])
                held_keys.append(x["keys"][np.repeat(fresh, sizes)])
                sizes = np.where(fresh, sizes, 0)
                held_lines.append(np.repeat(x["h"], sizes))
                held += len(held_keys[-1])
                rows = pa.array(x["row"] + lo)
                numbers = (pa.array(v.astype(np.int32)) for v in (x["words"], x["chars"], sizes))
                halves = (pa.array(half) for half in np.ascontiguousarray(x["sig"].T).view(np.int64))
                blank = [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())]
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x["no"].astype(np.int32)), pa.array(x["h"].view(np.int64)), *numbers, *halves, *blank], _NAMES)
                if held > HELD:
                    yield _entries(held_keys, held_lines, parts)
                    held_keys, held_lines, held = [], [], 0
        if held:
            yield _entries(held_keys, held_lines, parts)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all entries of some parts: those whose key ``c`` > 1 lines have, once each."""
    blobs = [np.frombuffer(b, np.int64) for batch in batches for b in batch.column(0).to_pylist()]
    if not blobs:
        return
    both = np.concatenate(blobs).reshape(-1, 2)
    del blobs
    both = both[np.argsort(both[:, 0])]
    same = both[1:, 0] == both[:-1, 0]
    both = both[np.append(same, False) | np.append(False, same)]
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    both = both[np.append(True, (both[1:] != both[:-1]).any(axis=1))[: len(both)]]
    _, at, c = np.unique(both[:, 0], return_inverse=True, return_counts=True)
    c = c[at]
    key, h = np.ascontiguousarray(both[c > 1].T)
    c = c[c > 1]
    for lo in range(0, len(c), 100_000):
        yield pa.record_batch([pa.array(x[lo : lo + 100_000]) for x in (h, c, key)], ["h", "c", "key"])


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normalised lines; of rows that repeat a document, the task takes the first."""
    seen: set[int] = set()
    for batch in batches:
        ids, lines = [], []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if wanted[0]["h"] in seen:
                continue
            seen.add(wanted[0]["h"])
            if len(seen) > 1_000_000:
                seen.clear()
            parts = text.split("\n")
            for w in wanted:
                ids.append(w["h"])
                lines.append(normalise(parts[w["line_no"]]))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["id", "line"])


def _similar_lines(percent: int):
    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(all_similar(a.tolist(), b.tolist(), percent), dtype=bool)

    return check


def _bound(percent: int):
    """Whether two marks (words, chars, sig, sig2) leave room for similar lines."""

    def possible(a: Column, b: Column) -> Column:
        lengths = 100 * F.least(a["chars"], b["chars"]) >= percent * F.greatest(a["chars"], b["chars"])
        bits = F.bit_count(a["sig"].bitwiseXOR(b["sig"])) + F.bit_count(a["sig2"].bitwiseXOR(b["sig2"]))
        words, most = F.least(a["words"], b["words"]), F.lit(None).cast("int")
        for least, at_most in sorted(MAX_BITS):
            most = F.when(words >= least, at_most).otherwise(most)
        return lengths & (bits <= most)

    return possible


def _members(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, id, mark, c``: the blocks to join on, the rarest ones of each line, that ``c`` > 1 lines have."""
    shared = save(entries.repartition("part").select("entries").mapInArrow(_shared, "h long, c long, key long"))
    met = shared.groupBy("h").agg(F.collect_list(F.struct("c", "key")).alias("met"))
    lines = nodes.select("h", "words", "n_blocks", F.struct("words", "chars", "sig", "sig2").alias("mark"))
    lines = save(met).join(lines, "h")
    asked = F.when(F.col("words") <= THIRDED, 2).otherwise(F.ceil(F.col("n_blocks") / SHARE))
    asked = F.least(asked, F.col("n_blocks"))
    # blocks of no other line are the rarest of all
    joined = F.greatest(F.size("met") - asked + 1, F.lit(0)).cast("int")
    rarest = F.slice(F.sort_array("met"), F.lit(1), joined)
    rows = save(lines.select("h", "mark", F.explode(rarest).alias("x")).select("x.key", F.col("h").alias("id"), "mark"))
    sizes = save(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    return save(rows.join(sizes, "key"))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """``doc_id, text_hash, lines`` (sorted numbers, from 0) of the lines that go."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    with scratch() as kept:
        schema = "doc_id long, text_hash long, line_no int, h long, words int, chars int, n_blocks int, sig long, sig2 long, part int, entries binary"
        parts = min(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 15)
        made = save(rows.mapInArrow(_occurrences(min_words, parts), schema))
        occurrences = made.filter("part is null")
        place = F.struct("doc_id", "text_hash", "line_no")
        marks = [F.max(c).alias(c) for c in ("words", "chars", "n_blocks", "sig", "sig2")]
        nodes = save(occurrences.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"), *marks))

        members = _members(made.filter("part is not null").select("part", "entries"), nodes)
        ids = members.select(F.col("id").alias("h")).distinct()
        wanted = nodes.join(ids, "h").groupBy("first.doc_id", "first.text_hash").agg(F.collect_list(F.struct(F.col("first.line_no"), "h")).alias("wanted"))
        texts = _with_key(docs, save(wanted), "inner").select(F.col("text").cast("string"), "wanted")
        lines = save(texts.mapInArrow(_wanted_lines, "id long, line string"))

        def verify(pairs: DataFrame) -> DataFrame:
            both = pairs.join(lines.toDF("u", "x"), "u").join(lines.toDF("v", "y"), "v")
            return both.filter(_similar_lines(percent)("x", "y")).select("u", "v")

        labels = link_buckets(members, verify, _bound(percent), pivots=PIVOTS)
        labels = labels.union(labels.select("component", "component").distinct())
        tagged = nodes.join(labels.withColumnRenamed("id", "h"), "h", "left").filter("n > 1 or component is not null")
        tagged = save(tagged.select("h", "first", F.coalesce("component", "h").alias("part")))
        stays = save(tagged.groupBy("part").agg(F.min("first").alias("kept")))
        gone = occurrences.join(save(tagged.join(stays, "part").select("h", "kept")), "h").filter(~place.eqNullSafe(F.col("kept")))
        out = save(gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("lines")))
        kept.append(out)
    return out


def _with_key(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to ``other (doc_id, text_hash, ...)``, which keeps the names ``_d`` and ``_t``; nulls meet nulls."""
    other = other.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"}).hint("shuffle_hash")
    same_id = docs["doc_id"].cast("long").eqNullSafe(other["_d"])
    return docs.join(other, same_id & (F.xxhash64(docs["text"].cast("string")) == other["_t"]), how)


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """``docs`` with texts that leave the dropped lines out, and ``n_dropped``, how many went."""
    docs = docs.drop("n_dropped")
    gone = dropped_lines(docs, min_words, percent)
    out = _with_key(docs, gone, "left")
    lines, text = gone["lines"], docs["text"]
    left = F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains(lines, k))
    text = F.when(lines.isNull(), text).otherwise(F.array_join(left, "\n")).alias("text")
    others = [text if c == "text" else docs[c] for c in docs.columns]
    return out.select(*others, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_dropped"))

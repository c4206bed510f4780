"""Message texts: serialisation, token estimates, fingerprints, names and chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2000
OVERLAP_BYTES = 200
_SENTENCE_ENDS = (". ", "! ", "? ", ".\t", "!\t", "?\t")
#: The characters that count as white space at the ends of a text.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Device names that no file may have.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{port}{n}" for port in ("COM", "LPT") for n in range(1, 10)))
#: Seconds in each unit of a duration.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"


def serialised(role: Column, text: Column) -> Column:
    """``[ROLE] text``, the form that is scored and fingerprinted."""
    return F.concat(F.lit("["), F.upper(role), F.lit("] "), F.coalesce(text, F.lit("")))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def _bytes(text: Column, first: Column | int, n: Column | int) -> Column:
    """``n`` bytes of the text from byte ``first`` (from 1); a torn character keeps its bytes."""
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substring(F.encode(text, "utf-8"), as_column(first), as_column(n)).cast("string")


def short_name(text: Column, most: int = 60, least: int = 30) -> Column:
    """Names of up to ``most`` bytes as they are; others end with dots, at the last space among
    the bytes ``least`` to ``most - 3`` or else after ``most - 3`` bytes."""
    late = _bytes(text, least + 1, most - 2 - least)
    rest = F.octet_length(F.substring_index(late, " ", -1))
    at = F.when(F.instr(late, " ") > 0, least + F.octet_length(late) - rest - 1).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(_bytes(text, 1, at.cast("int")), F.lit("...")))


def safe_file_name(name: Column, most: int = 255) -> Column:
    """The last path component without separators, NULs, white space around it or leading dots.

    Reserved device names get an underscore before them; names of more than ``most`` bytes lose
    their middle, so that the extension stays. A name of which nothing is left is empty.
    """
    last = F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1)
    clean = F.regexp_replace(last, r"[/\\\x00]", "")
    clean = F.regexp_replace(F.btrim(clean, F.lit(WHITE)), r"^\.+", "")
    named = F.when(F.upper(F.substring_index(clean, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
    ext = F.regexp_extract(named, r"(\.[^.]*)$", 1)
    keep = F.greatest(most - F.octet_length(ext), F.lit(1))
    return F.when(F.octet_length(named) > most, F.concat(_bytes(named, 1, keep), ext)).otherwise(named)


def front_matter(text: Column) -> Column:
    """The ``key: value`` lines between two ``---`` lines at the start, as a map."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.instr(x, ":") > 0)
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, 1 << 30)).alias("v")))
    return F.map_from_entries(pairs)


def duration_seconds(text: Column) -> Column:
    """``2h30m``, ``90s``, ``1.5h``, ``-5m`` or ``0`` in seconds; null where it is no duration."""
    good = text.rlike(rf"^[+-]?(0|({_PART})+)$")
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    number = lambda x: F.regexp_extract(x, r"^[0-9.]+", 0).cast("double")
    parts = F.transform(F.regexp_extract_all(text, F.lit(_PART), F.lit(0)), lambda x: number(x) * F.element_at(units, F.regexp_extract(x, r"[^0-9.]+$", 0)))
    total = F.aggregate(parts, F.lit(0.0), lambda n, x: n + x)
    return F.when(good, F.when(text.startswith("-"), -total).otherwise(total))


def _boundary(data: bytes, start: int, end: int, window: int) -> int:
    """Where a piece that must end by ``end`` should: paragraph, line, sentence, space, then a whole character."""
    low = max(start, end - window)
    part = data[low:end]
    for marks in (("\n\n",), ("\n",), *((m,) for m in _SENTENCE_ENDS), (" ", "\t")):
        ends = [at + len(m) for m in marks if (at := part.rfind(m.encode())) >= 0]
        if ends:
            return low + max(ends)
    while end > start + 1 and data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def split(text: str, most: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple[int, str, int, int, int]]:
    """``(index, text, byte_start, byte_end, token_estimate)`` pieces of the trimmed text; no character is torn."""
    data = text.strip(WHITE).encode()
    most = most if most > 0 else CHUNK_BYTES
    overlap = max(overlap, 0)
    overlap = overlap if overlap < most else most // 4
    out, start = [], 0
    while start < len(data):
        end = len(data) if len(data) - start <= most else _boundary(data, start, start + most, most // 2)
        piece = data[start:end].decode(errors="ignore").strip(WHITE)
        if piece:
            out.append((len(out), piece, start, end, (len(piece.encode()) + 3) // 4))
        if end >= len(data):
            break
        back = max(end - overlap, start + 1)
        while back < end and data[back] & 0xC0 == 0x80:
            back += 1
        start = back
    return out


def chunks(messages: DataFrame, key: str = "id", most: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """A row per chunk of every text: ``key, chunk_index, text, byte_start, byte_end, tokens``."""
    rows = messages.select(F.col(key).cast("string").alias(key), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = [(k, *c) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for c in split(t or "", most, overlap)]
                cols = list(zip(*made)) or [()] * 6
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], [key, "chunk_index", "text", "byte_start", "byte_end", "tokens"])

    return rows.mapInArrow(run, f"{key} string, chunk_index int, text string, byte_start int, byte_end int, tokens int")


#: Wordings by which models say that the context was too long, in lower case.
OVERFLOW = (
    "context window exceeds limit",
    "context length exceeded",
    "maximum context length",
    "context_length_exceeded",
    "prompt is too long",
    "input is too long",
    "requested tokens",
    "exceeds the maximum",
    "too many tokens",
    "context window",
)


def is_overflow(error: Column) -> Column:
    """Whether a model's error message says that the context was too long; a null message doesn't."""
    low = F.lower(error)
    return F.coalesce(reduce(Column.__or__, [low.contains(p) for p in OVERFLOW]), F.lit(False))


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes, 64 bits, as ``decimal(20,0)``; null for null.

    The product with 2^40 + 435 modulo 2^64 is worked out in two limbs of 32 bits.
    """
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit(".."), F.lit(0))
    low = 0xFFFFFFFF

    def step(state: Column, pair: Column) -> Column:
        lo = state["lo"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        part = lo * 435
        return F.struct((state["hi"] * 435 + F.shiftright(part, 32) + F.shiftleft(lo, 8)).bitwiseAND(low).alias("hi"), part.bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    whole = F.aggregate(pairs, start, step, lambda s: s["hi"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)") + s["lo"])
    return F.when(text.isNotNull(), whole.cast("decimal(20,0)"))

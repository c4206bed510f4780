"""WARC archives: written one gzip member per record, read back sequentially.

Records with equal payloads are linked: the one with the smallest id is a response, the others are
revisits that name it. Payload digests come from the JVM and only narrow columns are grouped, so a
payload that is shared by very many pages is no hot key for the pages themselves. The reader
inflates one member at a time from fixed-size blocks, frames records by Content-Length and verifies
block and payload digests.

Archives go to a folder that all executors share; one is written under a name of its attempt and
then moved, so that a task that runs again replaces it whole.

Defined cases: a null payload is the empty one; rows that repeat a page_id and payload are all
responses where the id is the payload's smallest; rows without page_id are revisits where a row
with an id has the payload, else responses; an empty table writes no archive; extra columns are
ignored, but url is kept as the target (a null one is left out).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.token_files import _move, _open_in, _open_out
from threadloom.llm.work import save

BLOCK = 1 << 16
LEVEL = 6
#: Fixed values of the WARC 1.1 format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page_of(record_id: str | None) -> int | None:
    inner = (record_id or "none").strip("<>").rpartition(":")[2]
    return None if inner == "none" else int(inner)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member. With ``refers_to`` it is a revisit, which leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", _PROFILE)]
    head = _VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(head + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def _members(source: BinaryIO) -> Iterator[bytes]:
    """The contents of each gzip member, inflated from blocks of fixed size."""
    data = source.read(BLOCK)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data and not (data := source.read(BLOCK)):
                raise ValueError("the archive ends within a gzip member")
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
        yield b"".join(parts)
        data = data or source.read(BLOCK)


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, framed and verified."""
    for member in _members(source):
        head, gap, rest = member.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if not gap or not first.startswith(b"WARC/"):
            raise ValueError("no WARC record starts here")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        length = int(fields["content-length"])
        block, end = rest[:length], rest[length:]
        if len(block) != length or end != b"\r\n\r\n":
            raise ValueError("a record's length differs from its Content-Length")
        if (said := fields.get("warc-block-digest")) and said != "sha1:" + base32_sha1(block):
            raise ValueError("a record's block digest differs")
        yield fields, block


def _page(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    sizes = [int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    n = sizes[0] if sizes else len(payload)
    if not revisit and (n != len(payload) or digest != base32_sha1(payload)):
        raise ValueError("a payload's size or digest differs")
    refers = _page_of(fields.get("warc-refers-to")) if revisit else None
    return _page_of(fields["warc-record-id"]), n, digest, fields["warc-type"], refers, fields.get("warc-target-uri"), None if revisit else payload


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, sha1, first_id`` of the rows whose payload, of ``least`` bytes or more, has a smaller id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.filter(F.octet_length(payload) >= least).select(F.col("page_id").cast("long"), F.sha1(payload.cast("binary")).alias("sha1"))
    counted = save(keyed.groupBy("sha1", "page_id").agg(F.count("*").alias("n")))
    firsts = counted.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c")).filter("c > 1 and first_id is not null")
    return save(counted.join(save(firsts.drop("c")), "sha1").filter("not page_id <=> first_id").select("page_id", "sha1", "first_id"))


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages (page_id, url, html)`` as archives below ``folder``; returns ``path, n_records``."""
    again = revisits(pages, least).select(F.col("page_id").alias("_p"), F.col("sha1").alias("_s"), "first_id")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.sha1("payload") == F.col("_s")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out, part = 0, None, TaskContext.get().partitionId()
        name = f"{folder}/.{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or _open_out(name)
                out.write(record(*row))
                n += 1
        if out is not None:
            out.close()
            _move(name, final := f"{folder}/part-{part:06d}.warc.gz")
            yield pa.record_batch([pa.array([final]), pa.array([n])], ["path", "n_records"])

    made = rows.select("page_id", "url", "payload", "first_id").sortWithinPartitions("page_id").mapInArrow(run, "path string, n_records long")
    return save(made)


def read_warc(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Every record of ``archives (path)``, one archive to a task; payload is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open_in(path) as source:
                    rows, held = [], 0
                    for fields, block in read_records(source):
                        rows.append(_page(fields, block))
                        held += len(block) + 200
                        if held > 8_000_000:
                            yield pa.record_batch(list(map(list, zip(*rows))), schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch(list(map(list, zip(*rows))), schema=schema)

    paths = archives.select("path")
    return paths.repartition(max(1, min(paths.count(), 10_000))).mapInArrow(run, RECORDS)

"""WARC archives: a distributed writer with revisit records, and a splittable
reader.

Writer: every record is a gzip member of its own.  Of pages with equal
payloads of at least ``REVISIT_BYTES``, that with the largest id carries the
payload (``response``); the others are ``revisit`` records that name it, with
the HTTP head (payload length included) but no body.  Each task writes one
archive under a name of its own in the shared folder and moves it into place
when complete; a manifest table names the archives of the tasks that
succeeded, so files of lost or repeated attempts are never read.

Reader: archives are cut into byte ranges, at most ``RANGES_PER_TASK`` to a
task, however small the rows that name them.  A task searches its ranges for
the gzip magic, validates a candidate by decoding the start of the member and
looking for a WARC header, and owns every record whose member starts inside
the range; its last record may run on beyond the end.  A candidate that fails
(magic bytes inside compressed data) is skipped.  A record that starts well
but is damaged or cut off is an error, and so is an archive in which fewer or
more records are found than its manifest says.

Scale: only (id, digest, length) rows are grouped, with partial aggregation,
so a payload shared by a third of all pages costs one row per task; the
pages themselves move once, to meet the ids of their responses.  Memory is one
record at a time.

Defined results: a null payload is empty; null ids are written as an empty id
and read back as null (a group of null ids only is all ``response``); rows
that repeat the winning id are all ``response``; an empty table gives no
archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import written

REVISIT_BYTES = 1000
RANGE_BYTES = 16 << 20
RANGES_PER_TASK = 4
MAGIC = b"\x1f\x8b\x08"
_PROBE = 512
_READ = 1 << 18
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = b"1970-01-01T00:00:00Z"

RECORD = (
    T.StructType()
    .add("page_id", "long")
    .add("payload_bytes", "long")
    .add("payload_digest", "string")
    .add("record_type", "string")
    .add("refers_to", "long")
)


def revisits(pages: DataFrame, key: str, text: str, least: int = REVISIT_BYTES) -> DataFrame:
    """``(digest, response)``: the largest id of each payload of at least
    ``least`` bytes that several rows share."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return (
        pages.select(F.col(key).cast("long").alias("id"), F.sha1(body).alias("digest"), F.length(body).alias("n"))
        .filter(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.count("*").alias("rows"), F.max("id").alias("response"))
        .filter("rows > 1 and response is not null")
        .select("digest", "response")
    )


def _b32(hex_digest: str) -> bytes:
    return base64.b32encode(bytes.fromhex(hex_digest))


def _hex(b32: bytes) -> str:
    return base64.b32decode(b32).hex()


def _record_id(ident) -> bytes:
    return b"<urn:page:%s>" % (b"" if ident is None else str(ident).encode())


def _page_id(field: bytes | None) -> int | None:
    inner = field[len(b"<urn:page:") : -1] if field else b""
    return int(inner) if inner else None


def record(ident, url: str | None, payload: bytes, digest: str, response) -> bytes:
    """One WARC/1.1 record.  ``response``: the id this record revisits, or
    None for a record with its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = response is not None
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c.isprintable() and not c.isspace()).encode()
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _record_id(ident),
        b"WARC-Date: " + _EPOCH,
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + _b32(digest),
        b"Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: " + _record_id(response)]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _uri(path: str) -> str:
    """``file:/x`` (Hadoop's spelling) as ``file:///x``."""
    return "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", text: str = "html", least: int = REVISIT_BYTES
) -> DataFrame:
    """Write the pages as ``*.warc.gz`` below ``folder`` (a path all
    executors share) and return the manifest ``(path, length, records)``."""
    folder = _uri(folder)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(key).cast("long").alias("id"),
        (F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")).alias("url"),
        body.alias("payload"),
        F.sha1(body).alias("digest"),
    )
    groups = written(revisits(pages, key, text, least), "warc-groups")
    rows = rows.join(groups, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
        system, base = _open_fs(folder)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{name}.part")
            columns = [b.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for i in range(b.num_rows):
                data = gzip_member(record(*[c[i].as_py() for c in columns]))
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            system.move(f"{base}/{name}.part", f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": [size], "records": [n]})

    made = rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, length long, records long")
    return written(made, "warc-manifest")


@dataclass
class Record:
    start: int
    header: dict[bytes, bytes]
    block: bytes

    @property
    def kind(self) -> str:
        return self.header.get(b"warc-type", b"").decode()

    def http(self) -> tuple[dict[bytes, bytes], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head), body


def _fields(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower()] = value.strip()
    return out


class _Window:
    """Bytes of a file from a moving start, read on demand."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.data = source, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = min(n, self.size - start)
        if n <= 0:
            return b""
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.source.seek(start)
            self.at, self.data = start, self.source.read(max(n, _READ))
        return self.data[start - self.at : start - self.at + n]


def _starts_record(window: _Window, at: int) -> bool:
    """Does a gzip member with a WARC header start here?"""
    try:
        return zlib.decompressobj(31).decompress(window.get(at, _PROBE), 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member's content and the offset after it; None if it is broken
    or cut off."""
    d = zlib.decompressobj(31)
    parts = []
    try:
        while not d.eof:
            data = window.get(at, _READ)
            if not data:
                return None
            parts.append(d.decompress(data))
            at += len(data)
    except zlib.error:
        return None
    return b"".join(parts), at - len(d.unused_data)


def read_range(source, size: int, start: int, end: int, strict: bool = False) -> Iterator[Record]:
    """The records whose members start in ``[start, end)`` of an archive.
    Damaged ones are left out, or raise if ``strict``."""
    window = _Window(source, size)
    at = start
    while at < end:
        data = window.get(at, _READ)
        if not data:
            return
        k = data.find(MAGIC)
        if k < 0:
            # the magic may lie across the border of two reads
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += k
        if at >= end:
            return
        starts = _starts_record(window, at)
        whole = _member(window, at) if starts else None
        if whole is None:
            if starts and strict:
                raise ValueError(f"the record at byte {at} is damaged or cut off")
            at += 1
            continue
        content, after = whole
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = _fields(head)
        yield Record(at, fields, rest[: int(fields.get(b"content-length", b"0"))])
        at = after


def ranges(archives: DataFrame, step: int = RANGE_BYTES) -> DataFrame:
    """``(path, length, start, end)``: the archives cut into byte ranges."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long")))
    cut = archives.filter("length > 0").select("path", "length", first.alias("start"))
    return cut.withColumn("end", F.least(F.col("start") + step, F.col("length")))


def archives_below(spark, folder: str) -> DataFrame:
    """``(path, length)`` of the archives in a folder, for archives that
    come without a manifest."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.col("path"), "length")


def dealt(cut: DataFrame) -> DataFrame:
    """Ranges in as many tasks as they need: the rows are a few numbers, the
    work behind each is not, so the number of tasks is given (a numbered
    layout is not merged)."""
    n = cut.count()
    tasks = max(1, -(-n // RANGES_PER_TASK), min(n, cut.sparkSession.sparkContext.defaultParallelism))
    return cut.repartitionByRange(tasks, "path", "start")


def read_archives(archives: DataFrame, step: int = RANGE_BYTES, strict: bool = True) -> DataFrame:
    """Read ``archives(path, length)`` back: ``RECORD``, one row per record,
    checked against the digest in its header.  Where a column ``records`` says
    how many an archive holds, another number found raises; ``strict=False``
    leaves damaged records out instead."""
    schema = T.StructType([*RECORD.fields]).add("path", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            for r in b.to_pylist():
                system, path = _open_fs(_uri(r["path"]))
                with system.open_input_file(path) as source:
                    for x in read_range(source, r["length"], r["start"], r["end"], strict):
                        rows.append((*_row(x), r["path"]))
                        if len(rows) >= 1000:
                            yield batch()
        if rows:
            yield batch()

    cut = written(ranges(archives, step).select("path", "length", "start", "end"), "warc-ranges")
    found = dealt(cut).mapInArrow(run, schema)
    if strict and "records" in archives.columns:
        found = written(found, "warc-records")
        n = found.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n"))
        told = archives.select("path", "records").join(n, F.col("path") == F.col("p"), "left")
        wrong = told.filter(F.coalesce("n", F.lit(0)) != F.col("records")).limit(3).collect()
        if wrong:
            raise ValueError("; ".join(f"{r['path']}: {r['n'] or 0} of {r['records']} records" for r in wrong))
    return found.drop("path")


def _row(x: Record) -> tuple:
    fields, body = x.http()
    told = _hex(x.header[b"warc-payload-digest"].removeprefix(b"sha1:"))
    if x.kind == "revisit":
        size, digest = int(fields[b"content-length"]), told
    else:
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        if digest != told:
            raise ValueError(f"payload of record at byte {x.start} does not match its digest")
    return (
        _page_id(x.header.get(b"warc-record-id")),
        size,
        digest,
        x.kind,
        _page_id(x.header.get(b"warc-refers-to")),
    )


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", step: int = RANGE_BYTES) -> DataFrame:
    """Write the pages to fresh archives in the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, key, url, text), step)

"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Records are WARC/1.1, each in a gzip member of its own (or plain). Where a check fails (a
member's CRC or end, the version line, a header, the content length, the block's digest) the
reader notes what it must pass over as quarantined, looks for the next member or version line
that starts a valid record, and goes on there. Of a whole member with a bad record the others are kept.

Files are read a block at a time, so that memory is bounded by the largest record, and time is in
proportion to the file. archived() fails if its archives do not give back as many records as
were written, or have gaps.

Nulls, ties, empties: a null html is an empty payload, a null url an empty target; line breaks
in a url are written as %0D and %0A; rows with a null page_id are records without an id, never
referred to; if the largest page_id of a payload repeats, each such row is a response; an empty
table gives no files; columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import commit_file, filesystem, new_path, stored

#: A file is closed once it has as many bytes.
FILE_BYTES = 32 << 20
#: Bytes that the reader holds of a file, records that are larger aside.
BLOCK_BYTES = 4 << 20
#: A header that is longer isn't valid.
HEADER_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"  # fixed: equal input gives equal files
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_ID = "<urn:page:%d>"
_ID_RE = re.compile(r"<urn:page:(-?\d+)>")


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """A response record, or a revisit (without the payload) of the page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {_base32(digest)}", f"WARC-Block-Digest: {_base32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    lines.append(f"WARC-Record-ID: {_ID % page_id if page_id is not None else '<urn:page:none>'}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_ID % refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def page_id(self) -> int | None:
        m = _ID_RE.fullmatch(self.headers.get("warc-record-id", ""))
        return int(m[1]) if m else None

    @property
    def refers_to(self) -> int | None:
        m = _ID_RE.fullmatch(self.headers.get("warc-refers-to", ""))
        return int(m[1]) if m else None

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int:
        """Of the full payload, which a revisit doesn't hold."""
        m = re.search(rb"(?mi)^content-length: (\d+)\r?$", self.block.partition(b"\r\n\r\n")[0])
        return int(m[1]) if m else len(self.payload)

    @property
    def payload_digest(self) -> str:
        value = self.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        return base64.b32decode(value).hex() if value else hashlib.sha1(self.payload).hexdigest()


class Damaged(ValueError):
    pass


class Source:
    """A file by offset: a block of it is held, and the next hit of each pattern is remembered, so that reading is linear."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.start, self.block = 0, b""
        self.hits: dict[bytes, int] = {}

    def view(self, at: int, n: int) -> memoryview:
        """The n bytes from at on, or those up to the end."""
        n = max(0, min(n, self.size - at))
        if not self.start <= at <= at + n <= self.start + len(self.block):
            self.file.seek(at)
            self.start, self.block = at, self.file.read(max(n, BLOCK_BYTES))
        return memoryview(self.block)[at - self.start : at - self.start + n]

    def find(self, pattern: bytes, at: int) -> int:
        """Where the pattern stands next, or the file's end."""
        if (known := self.hits.get(pattern, -1)) >= at:
            return known
        while at < self.size:
            held = self.start + len(self.block) - at  # what is left of the block, unless that is too little
            part = bytes(self.view(at, held if self.start <= at and held > len(pattern) else BLOCK_BYTES))
            if (i := part.find(pattern)) >= 0:
                at += i
                break
            at += max(1, len(part) - len(pattern) + 1)
        self.hits[pattern] = found = min(at, self.size)
        return found


def parse(source: Source, at: int, offset: int) -> tuple[Record, int]:
    """The record that starts at that place of the source, and where it ends."""
    if source.view(at, len(VERSION)) != VERSION:
        raise Damaged("no version line")
    n = 1 << 12
    while (head := bytes(source.view(at, n)).find(b"\r\n\r\n")) < 0:
        if n >= HEADER_BYTES or at + n >= source.size:
            raise Damaged("header without an end")
        n *= 4
    headers = {}
    for line in bytes(source.view(at, head)).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged("no content length")
    start = at + head + 4
    end = start + int(headers["content-length"])
    if end + 4 > source.size or source.view(end, 4) != b"\r\n\r\n":
        raise Damaged("no record end after the content length")
    block = bytes(source.view(start, end - start))
    want = headers.get("warc-block-digest")
    if want and want != _base32(hashlib.sha1(block).hexdigest()):
        raise Damaged("block digest differs")
    return Record(offset, headers, block), end + 4


def _member_at(source: Source, at: int) -> tuple[bytes, int]:
    """What the gzip member at that place holds, and where it ends."""
    z, out, end, step = zlib.decompressobj(31), [], at, 1 << 12
    while not z.eof:
        part = source.view(end, step)
        if not part:
            raise Damaged("gzip: the member has no end")
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from e
        end += len(part)
        step = min(2 * step, 1 << 20)
    return b"".join(out), end - len(z.unused_data)


def _records(raw: bytes, at: int, end: int, gaps: list[tuple[int, int, str]]) -> list[Record]:
    """The valid records of a whole member; what else it holds makes the member one of the gaps, too."""
    source, out, i, why = Source(io.BytesIO(raw), len(raw)), [], 0, None
    while i < len(raw):
        try:
            found, i = parse(source, i, at)
            out.append(found)
        except Damaged as e:
            why = why or f"in the member: {e}"
            i = source.find(VERSION, i + 1)
    if why or not out:
        gaps.append((at, end, why or "empty member"))
    return out


def read(data, quarantined: list[tuple[int, int, str]] | None = None) -> Iterator[Record]:
    """Records of an archive (bytes, or a Source); what isn't part of a valid one is added to quarantined as (start, end, reason)."""
    gaps = quarantined if quarantined is not None else []
    source = data if isinstance(data, Source) else Source(io.BytesIO(data), len(data))
    at, gap, why = 0, None, ""
    while at < source.size:
        try:
            if source.view(at, 3) == GZIP:
                raw, end = _member_at(source, at)
                found = None
            else:
                one, end = parse(source, at, at)
                found = [one]
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = min(source.find(GZIP, at + 1), source.find(VERSION, at + 1))
            continue
        if gap is not None:
            gaps.append((gap, at, why))
            gap = None
        yield from _records(raw, at, end, gaps) if found is None else found
        at = end
    if gap is not None:
        gaps.append((gap, source.size, why))


def write_archives(pages: DataFrame, folder: str, least: int = 1000, compress: bool = True) -> DataFrame:
    """Writes a record for each page; the manifest: uri, n_records, n_bytes.

    Of records with equal payloads of ``least`` bytes or more, that with the largest page_id is a response, the others revisit it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = F.col("n_bytes") >= least
    # A row for each payload and task is shuffled; then only payloads that repeat are kept.
    groups = rows.filter(large).groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("_first"), F.count("*").alias("n")).filter("n > 1 and _first is not null").drop("n")
    # Stored, so that the join below has plain exchanges on both sides and may split a payload that many pages share.
    groups = stored(groups, "payloads")
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    rows = rows.join(groups, F.col("digest") == F.col("_digest"), "left").withColumn("refers_to", refers)
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "n_bytes", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, size, no, done = TaskContext.get(), [], 0, 0, []

        def close() -> None:
            nonlocal parts, size, no
            if parts:
                uri = f"{folder}/part-{task.partitionId():07d}-{no:04d}.warc{'.gz' if compress else ''}"
                done.append({"uri": uri, "n_records": len(parts), "n_bytes": commit_file(uri, parts, task.taskAttemptId())})
                parts, size, no = [], 0, no + 1

        for b in batches:
            for r in b.to_pylist():
                data = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["n_bytes"], r["refers_to"])
                parts.append(member(data) if compress else data)
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("uri", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return stored(rows.mapInArrow(run, "uri string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record (kind 'record') and for each stretch of bytes that is not part of one (kind 'quarantined')."""
    schema = pa.schema([("kind", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                gaps: list[tuple[int, int, str]] = []
                rows = []
                fs, path = filesystem(uri)
                file = fs.open_input_file(path)
                for r in read(Source(file, file.size()), gaps):
                    rows.append({"kind": "record", "uri": uri, "offset": r.offset, "page_id": r.page_id, "url": r.headers.get("warc-target-uri"), "payload_bytes": r.payload_bytes, "payload_digest": r.payload_digest, "record_type": r.headers.get("warc-type"), "refers_to": r.refers_to})
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                rows += [{"kind": "quarantined", "uri": uri, "offset": lo, "end": hi, "reason": why} for lo, hi, why in gaps]
                file.close()
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "kind string, uri string, offset long, `end` long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("uri").repartition(max(1, manifest.count())).mapInArrow(run, ddl)


class Incomplete(RuntimeError):
    pass


def read_back(manifest: DataFrame) -> DataFrame:
    """read_archives(), stored, after it was held against the manifest: as many records in each file, and no gaps."""
    found = stored(read_archives(manifest), "records")
    got = found.groupBy("uri").agg(F.sum((F.col("kind") == "record").cast("long")).alias("got"), F.sum((F.col("kind") == "quarantined").cast("long")).alias("gaps"))
    wrong = manifest.join(got, "uri", "left").filter(~F.col("got").eqNullSafe(F.col("n_records")) | (F.col("gaps") > 0))
    if rows := wrong.limit(10).collect():
        said = "; ".join(f"{r['uri']}: {r['got'] or 0} of {r['n_records']} records, {r['gaps'] or 0} gaps" for r in rows)
        raise Incomplete(f"archives don't give back what was written, among them {said}")
    return found


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages to archives in the shared folder and returns what the archives hold, by page."""
    found = read_back(write_archives(pages, new_path(pages.sparkSession, "warc"), least))
    return found.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives with a salvage reader (operator 9).

The writer puts one record per page into archives of bounded size, each record
a gzip member of its own.  Of pages with equal payloads the one with the
largest page_id is a response; the others revisit it and hold only the HTTP
headers.

The reader checks each member and record (gzip trailer, version line, header
block, Content-Length, closing line ends, block digest).  After a failed check
it looks for the next valid member or version line, goes on from there, and
logs the bytes in between as a quarantined gap.

Defined results: a null html is an empty payload; rows with a null page_id are
written with an empty id, read back as null and always responses; rows repeated
with the same id are all responses; a payload of any length is one record;
empty tables give no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized, pieces

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 8 << 20
PIECE = 1 << 15
DATE = b"2024-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(data).digest())


def urn(page_id: int | None) -> bytes:
    return b"<urn:page:%b>" % (b"" if page_id is None else b"%d" % page_id)


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response, or a revisit when ``refers_to`` names another page."""
    kind = b"revisit" if refers_to is not None else b"response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: " + urn(page_id), b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()),
        b"WARC-Payload-Digest: sha1:" + sha1_base32(payload), b"WARC-Block-Digest: sha1:" + sha1_base32(block),
        b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block),
    ]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + urn(refers_to)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    """at, end: its place in the archive, or that of the member that holds it; inner: its place in that member's bytes."""

    at: int
    end: int
    headers: dict[bytes, bytes]
    block: bytes
    inner: int = 0


@dataclass
class Gap:
    at: int
    end: int
    reason: str
    inner: int = 0


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int = 0) -> tuple[dict[bytes, bytes], bytes, int]:
    """Headers, block and end of the record at ``at``; Damaged if a check fails."""
    if not re.compile(rb"WARC/1\.\d\r?\n").match(data, at):
        raise Damaged("no version line")
    close = data.find(b"\r\n\r\n", at)
    if close < 0:
        raise Damaged("no end of headers")
    headers = {}
    for line in data[at:close].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[name.strip().lower()] = value.strip()
    size = headers.get(b"content-length", b"")
    if not size.isdigit():
        raise Damaged("no Content-Length")
    start, end = close + 4, close + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block doesn't end where Content-Length says")
    block = data[start:end]
    digest = headers.get(b"warc-block-digest")
    if digest and digest.startswith(b"sha1:") and digest[5:] != sha1_base32(block):
        raise Damaged("block digest")
    return headers, block, end + 4


def inflated(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """The bytes of the member at ``at``, its end and why it is damaged (then with the bytes up to there), if it is."""
    z, out, place, step = zlib.decompressobj(31), [], at, PIECE
    while not z.eof and place < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(data[place : place + step]))
            place += step
        except zlib.error as e:
            if step == 1:
                return b"".join(out), place, f"gzip: {str(e)[:60]}"
            z, step = before, 1  # what comes before the damage is not lost
    if not z.eof:
        return b"".join(out), len(data), "gzip: no end of the member"
    return b"".join(out), min(place, len(data)) - len(z.unused_data), ""


def records_in(data: bytes, sure: bool = True) -> Iterator[Record | Gap]:
    """The valid records of a member's bytes and the gaps between.  Unless it is ``sure`` that the bytes are right, a record
    without a digest counts as damaged."""
    at, bad, why = 0, -1, ""
    while at < len(data):
        try:
            headers, block, end = parse_record(data, at)
            if not sure and not headers.get(b"warc-block-digest", b"").startswith(b"sha1:"):
                raise Damaged("no digest in a damaged member")
        except Damaged as e:
            if bad < 0:
                bad, why = at, str(e)
            at = data.find(b"WARC/1.", at + 1)
            at = len(data) if at < 0 else at
            continue
        if bad >= 0:
            yield Gap(bad, at, why)
            bad = -1
        yield Record(at, end, headers, block)
        at = end
    if bad >= 0:
        yield Gap(bad, len(data), why)


class Marks:
    """The next place of a mark from a place that only grows, each byte being searched once."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.at = data, mark, -1

    def after(self, at: int) -> int:
        if self.at <= at < len(self.data):
            found = self.data.find(self.mark, at + 1)
            self.at = len(self.data) if found < 0 else found
        return self.at


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Every record that passes its checks, and the gaps between, in order of place.

    A member may hold several records, and what is damaged in it is a gap with a place inside it.  Of a member that fails
    or ends early, the records before that stay if their digests hold, and the member is a gap."""
    at, bad, why = 0, -1, ""
    view, marks = memoryview(data), [Marks(data, MAGIC), Marks(data, b"WARC/1.")]
    while at < len(data):
        held: list[Record | Gap] = []
        try:
            if data.startswith(MAGIC, at):
                plain, end, failed = inflated(view, at)
                held = [replace(x, at=at, end=end, inner=x.at) for x in records_in(plain, not failed)]
                if failed:
                    held = [x for x in held if isinstance(x, Record)]
                    raise Damaged(failed)
                if not any(isinstance(x, Record) for x in held):
                    raise Damaged(held[0].reason if held else "an empty member")
            else:
                headers, block, end = parse_record(data, at)
                held = [Record(at, end, headers, block)]
        except Damaged as e:
            yield from held
            if bad < 0:
                bad, why = at, str(e)
            at = min(x.after(at) for x in marks)
            continue
        if bad >= 0:
            yield Gap(bad, at, why)
            bad = -1
        yield from held
        at = end
    if bad >= 0:
        yield Gap(bad, len(data), why)


def with_targets(pages: DataFrame) -> DataFrame:
    """page_id, url, html and target: the largest id with an equal payload (null without an id)."""
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], F.coalesce(pages["html"], F.lit("")).alias("html"))
    digest = F.concat(F.sha1("html"), F.length("html").cast("string"))
    # One row per payload; copies merge before the shuffle.  The pages side is only split, never gathered.
    largest = materialized(own.groupBy(digest.alias("digest")).agg(F.max("page_id").alias("target"), F.count("*").alias("copies")))
    own = own.withColumn("digest", digest)
    again = largest.where("copies > 1").select("digest", "target")
    return own.join(again, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id").isNotNull(), F.coalesce("target", "page_id")).alias("target"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, noise: bytes = b"") -> DataFrame:
    """Rows (archive, content, records, second): WARC files of bounded size, or of a single record; how many records they have and
    where the first ends.  ``noise`` comes there in each."""
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("records", pa.int64()), ("second", pa.int64())])

    def run(batches):
        parts, size, n, task = [], 0, 0, TaskContext.get().partitionId()

        def ready():
            nonlocal parts, size, n
            pages = len(parts) - (1 if noise else 0)
            made = pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary()), pa.array([pages], pa.int64()), pa.array([len(parts[0])], pa.int64())], schema=schema)
            parts, size, n = [], 0, n + 1
            return made

        for batch in pieces(batches):
            for page_id, url, html, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "target")), strict=True):
                parts.append(member(record(page_id, url, html.encode(), None if target == page_id else target)))
                size += len(parts[-1])
                if len(parts) == 1 and noise:
                    parts.append(noise)
                if size >= archive_bytes:
                    yield ready()
        if parts:
            yield ready()

    return with_targets(pages).mapInArrow(run, "archive string, content binary, records long, second long")


RECORDS = "archive string, start long, end long, gap string, record_id string, record_type string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read_archives(archives: DataFrame, planted: int = 0) -> DataFrame:
    """One row per record, and per quarantined gap (``gap`` then tells why).

    ``planted``: the bytes of the damaged record that each archive has after its first one (``write_archives`` with noise).
    The reader then fails unless that is the only gap, by its place, length and reason, and every record written is there."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])
    text = lambda x: None if x is None else x.decode("utf-8", "replace")

    def row(archive, x):
        if isinstance(x, Gap):
            return (archive, x.at, x.end, x.reason, *[None] * 7)
        head, _, payload = x.block.partition(b"\r\n\r\n")
        h = x.headers
        kind = h.get(b"warc-type")
        length = re.search(rb"\r\nContent-Length: (\d+)", head)
        n = int(length[1]) if kind == b"revisit" and length else len(payload)
        digest = h.get(b"warc-payload-digest") if kind == b"revisit" else b"sha1:" + sha1_base32(payload)
        return (
            archive, x.at, x.end, None, text(h.get(b"warc-record-id")), text(kind), text(h.get(b"warc-target-uri")),
            text(digest and digest.removeprefix(b"sha1:")), n, text(h.get(b"warc-refers-to")), None if kind == b"revisit" else payload,
        )

    def run(batches):
        for batch in batches:
            told = (batch.column("records").to_pylist(), batch.column("second").to_pylist()) if planted else ([0] * batch.num_rows,) * 2
            for archive, content, count, second in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), *told, strict=True):
                held, size = [], 0
                gaps, records = [], 0
                for x in read_archive(content or b""):
                    held.append(row(archive, x))
                    if isinstance(x, Gap):
                        gaps.append((x.at, x.end, x.reason))
                    else:
                        records += 1
                    size += len(held[-1][-1] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=schema)
                        held, size = [], 0
                if planted and (gaps != [(second, second + planted, "block digest")] or records != count):
                    raise ValueError(f"{archive}: {records} of {count} records, gaps {gaps[:5]}")
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=schema)

    columns = ["archive", "content", *(["records", "second"] if planted else [])]
    return archives.select(*[archives[c] for c in columns]).mapInArrow(run, RECORDS)


def damaged_record() -> bytes:
    """A record, not compressed, whose payload isn't what its digest says."""
    return record(0, "damaged", b"as written").replace(b"as written", b"as altered")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page, reads the archives back, and gives a row per page.

    Each archive also gets a damaged record, which the reader has to skip; that is the only gap there may be, and every page
    must be there, or else the query fails, as a page in a gap would be lost."""
    noise = damaged_record()
    seen = read_archives(materialized(write_archives(pages, noise=noise)), planted=len(noise)).where("gap IS NULL")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")
    return seen.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))

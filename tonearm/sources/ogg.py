"""Ogg streams: pages with lacing and checksums, and the packets that they hold.

A page that fails its checks is a row that says so, and reading goes on at the next one; a packet is given when all its pages are
there.  What a codec would make of a packet is not known here, but by how many frames each is to be trimmed is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import pieces, small_batches

CONTINUED, FIRST, LAST = 1, 2, 4
#: Granule of a page on which no packet ends.
NONE = -1
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 from the highest bit on, beginning with zero: that of the reversed bytes in the library's order, reversed."""
    x = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def write_stream(packets: Iterable[tuple[bytes, int]], serial: int, segments: int = 255) -> bytes:
    """Pages of at most so many segments, of packets and the granules they end at."""
    lacing, bodies, granules = bytearray(), [], []
    for data, granule in packets:
        n = len(data) // 255
        for i in range(n + 1):
            lacing.append(255 if i < n else len(data) % 255)
            bodies.append(data[255 * i : 255 * i + lacing[-1]])
            granules.append(granule if i == n else NONE)
    out = []
    for i in range(0, len(lacing), segments):
        own = lacing[i : i + segments]
        flags = (CONTINUED if i and lacing[i - 1] == 255 else 0) | (0 if i else FIRST) | (LAST if i + segments >= len(lacing) else 0)
        ends = [g for g in granules[i : i + segments] if g != NONE]
        out.append(page(flags, ends[-1] if ends else NONE, serial, len(out), bytes(own), b"".join(bodies[i : i + segments])))
    return b"".join(out)


def read_pages(data: bytes) -> Iterator[tuple[int, int, tuple | None]]:
    """start, end and (flags, granule, serial, sequence, lacing, body) of each page, or None for what isn't one."""
    at, bad = 0, None
    while at < len(data):
        found = None
        if data.startswith(b"OggS", at) and at + 27 <= len(data):
            _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data) and checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc:
                found = (flags, granule, serial, sequence, lacing, data[at + 27 + n : end])
        if found is None:
            bad = at if bad is None else bad
            at = data.find(b"OggS", at + 1)
            at = len(data) if at < 0 else at
            continue
        if bad is not None:
            yield bad, at, None
            bad = None
        yield at, end, found
        at = end
    if bad is not None:
        yield bad, len(data), None


#: A packet: the page it ends on, its granule where it is the page's last, and its bytes; a broken place: its bytes' place.
PACKETS = "serial long, sequence long, granule long, content binary, at long, ends long, error string"


def read_packets(data: bytes) -> Iterator[tuple]:
    open_: dict[int, tuple[int, list[bytes]]] = {}  # serial -> the next page's number, and a packet that goes on
    for at, end, own in read_pages(data):
        if own is None:
            yield None, None, None, None, at, end, "DECODE_ERROR"
            continue
        flags, granule, serial, sequence, lacing, body = own
        wanted, parts = open_.get(serial, (sequence, []))
        whole = sequence == wanted and bool(flags & CONTINUED) == bool(parts)
        parts, skip = (parts, False) if whole else ([], bool(flags & CONTINUED))
        place, ready = 0, []
        for n in lacing:
            parts.append(body[place : place + n])
            place += n
            if n < 255:
                if not skip:
                    ready.append(b"".join(parts))
                parts, skip = [], False
        for i, x in enumerate(ready):
            yield serial, sequence, granule if i == len(ready) - 1 and granule != NONE else None, x, at, end, None
        # A packet whose beginning is lost goes on being skipped.
        open_[serial] = (sequence + 1, [] if skip else parts)


def packets(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key and PACKETS of each file of a table of bytes; a null or empty one is INVALID_SOURCE."""
    made = StructType([files.schema[key], *StructType.fromDDL(PACKETS).fields])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, content):
            for i, data in enumerate(batch.column(content).to_pylist()):
                rows = list(read_packets(data)) if data else [(None, None, None, None, 0, 0, "INVALID_SOURCE")]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([i] * len(rows))), *columns], names=made.names)

    small_batches(files.sparkSession)
    return files.select(key, content).mapInArrow(run, made)


def trims(decoded: DataFrame, key: str, order: list[str], frames: str, granule: str, pre_skip: Column) -> DataFrame:
    """``decoded`` with start, end and retained: the frames of each packet that are dropped at either side.

    The first ``pre_skip`` frames of a stream go, and what its last granule leaves out at the end; a trim never takes more than a
    packet has."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.sum(frames).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max(granule).over(Window.partitionBy(key))
    start = F.least(F.greatest(pre_skip - before, F.lit(0)), F.col(frames)).cast("long")
    own = decoded.withColumns({"_before": before, "_last": last, "start": start})
    end = F.least(F.greatest(F.col("_before") + F.col(frames) - F.coalesce("_last", F.lit((1 << 63) - 1)), F.lit(0)), F.col(frames) - F.col("start")).cast("long")
    return own.withColumn("end", end).withColumn("retained", F.col(frames) - F.col("start") - F.col("end")).drop("_before", "_last")

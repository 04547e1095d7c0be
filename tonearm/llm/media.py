"""ISO media containers (operator 3).

``store_media`` lays a payload down losslessly as frames of a raw 8-bit video
track (ftyp, mdat, moov with its sample tables).  ``read_media`` takes any
container column: it walks the nested boxes, decodes the sample tables and
gives codec, time scale, duration, frame size and the byte range of every
keyframe, and never looks into a payload.

Defined results: a null or empty text is one frame of padding; a null or
damaged container gives codec null and no ranges; a text of any length is one
container (64-bit boxes and offsets where 32 don't do); null ids, repeated rows
and empty tables pass through; of several video tracks the first counts.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts_of

FRAME = 576  # 24 x 24 samples of eight bits
WIDTH = HEIGHT = 24
TIMESCALE, DELTA = 25, 1
KEYFRAME_EVERY, CHUNK_FRAMES = 16, 64
PAD = b"\xff"
#: Boxes that hold other boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    """The payload: 255s up to a positive multiple of a frame."""
    return data + PAD * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """A movie of one raw grey track whose frames are the payload's."""
    n = len(payload) // FRAME
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
    mdat = box(b"mdat", payload)
    first = len(head) + len(mdat) - len(payload)
    chunks = -(-n // CHUNK_FRAMES)
    offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK_FRAMES * FRAME)
    runs = [(1, CHUNK_FRAMES, 1)] if n >= CHUNK_FRAMES else []
    if n % CHUNK_FRAMES:
        runs.append((chunks, n % CHUNK_FRAMES, 1))
    keys = np.arange(1, n + 1, KEYFRAME_EVERY)
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)
    )  # depth 40: grey of eight bits
    wide = offsets[-1] >= 1 << 32
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, DELTA)),
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    length = n * DELTA
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, length, 0x55C4, 0))
    hdlr = full(b"hdlr", b"mhlr", b"vide", bytes(12), b"\0")
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(16), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, length, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    return head + mdat + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))


@dataclass
class Track:
    codec: str | None = None
    handler: str | None = None
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def boxes(data: memoryview, at: int, end: int):
    """(kind, body start, body end) of the boxes side by side; ValueError when they don't fit."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} ends outside its parent")
        yield kind, body, at + size
        at += size
    if at != end:
        raise ValueError(f"{end - at} bytes after the last box")


def _table(data: memoryview, at: int, end: int, count: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if at + count * size > end:
        raise ValueError("a sample table ends outside its box")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _sample_offsets(runs: np.ndarray, chunk_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each sample's place: its chunk's, plus the samples before it there."""
    chunks = len(chunk_at)
    if not len(runs) or not chunks:
        return np.zeros(0, np.int64)
    first = runs[:, 0] - 1
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(first, chunks)))
    chunk_of = np.repeat(np.arange(chunks), per_chunk)[: len(sizes)]
    before = np.cumsum(sizes[: len(chunk_of)]) - sizes[: len(chunk_of)]
    start = np.searchsorted(chunk_of, np.arange(chunks))
    start = np.minimum(start, max(0, len(before) - 1))
    return chunk_at[chunk_of] + before - before[start][chunk_of]


def read_tracks(content: bytes) -> list[Track]:
    data = memoryview(content)
    tracks: list[Track] = []

    def walk(at: int, end: int, track: Track | None, found: dict) -> None:
        for kind, a, b in boxes(data, at, end):
            if kind == b"trak":
                own: dict = {}
                walk(a, b, new := Track(), own)
                if "sizes" in own:
                    new.sizes = own["sizes"]
                    new.offsets = _sample_offsets(own.get("runs", np.zeros((0, 3), np.int64)), own.get("chunks", np.zeros(0, np.int64)), new.sizes)
                    if len(new.offsets) and int((new.offsets + new.sizes[: len(new.offsets)]).max()) > len(content):
                        raise ValueError("a sample lies outside the file")
                    new.keys = own.get("keys", np.arange(1, len(new.sizes) + 1))
                    new.keys = new.keys[(new.keys > 0) & (new.keys <= len(new.offsets))]
                tracks.append(new)
            elif kind in CONTAINERS:
                walk(a, b, track, found)
            elif track is None:
                continue
            elif kind == b"mdhd":
                if data[a] == 1:
                    track.timescale, track.duration = struct.unpack_from(">IQ", data, a + 20)
                else:
                    track.timescale, track.duration = struct.unpack_from(">II", data, a + 12)
            elif kind == b"hdlr":
                if track.handler is None or bytes(data[a + 4 : a + 8]) != b"dhlr":
                    track.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                for code, c, d in boxes(data, a + 8, b):
                    track.codec = code.decode("latin-1")
                    if track.handler == "vide" and d - c >= 28:
                        track.width, track.height = struct.unpack_from(">HH", data, c + 24)
                    break
            elif kind == b"stsz":
                size, count = struct.unpack_from(">II", data, a + 4)
                if size and size * count > len(content):
                    raise ValueError("more samples than bytes")
                found["sizes"] = np.full(count, size, np.int64) if size else _table(data, a + 12, b, count, ">u4")
            elif kind == b"stss":
                found["keys"] = _table(data, a + 8, b, struct.unpack_from(">I", data, a + 4)[0], ">u4")
            elif kind == b"stsc":
                found["runs"] = _table(data, a + 8, b, 3 * struct.unpack_from(">I", data, a + 4)[0], ">u4").reshape(-1, 3)
            elif kind in (b"stco", b"co64"):
                found["chunks"] = _table(data, a + 8, b, struct.unpack_from(">I", data, a + 4)[0], ">u4" if kind == b"stco" else ">u8")

    walk(0, len(data), None, {})
    return tracks


def samples(content: bytes, track: Track) -> bytes:
    """The stored bytes of a track's samples in order."""
    at, size = track.offsets, track.sizes[: len(track.offsets)]
    joined = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    starts, ends = np.append(0, joined), np.append(joined, len(at))
    return b"".join(content[at[a] : at[b - 1] + size[b - 1]] for a, b in zip(starts, ends, strict=True) if b > a)


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8, and the container with it."""

    def run(batches):
        for batch in pieces(batches):
            data = [x.encode() for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([write_container(padded(x)) for x in data], pa.binary())], schema=_STORED
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = "codec string, timescale long, duration long, width long, height long, n_samples long, keyframes array<struct<first:long,length:long>>, error string"
_KEY = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))


def _ranges(per_row: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a, _ in per_row]).astype(np.int32)
    first, length = (np.concatenate([x[i] for x in per_row]) if per_row else np.zeros(0, np.int64) for i in (0, 1))
    both = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(length, pa.int64())], fields=list(_KEY.value_type))
    return pa.ListArray.from_arrays(pa.array(ends), both, type=_KEY)


def read_media(df: DataFrame, column: str = "media", with_payload: bool = False) -> DataFrame:
    """The columns of ``df`` and what its containers say of their first video (or else first) track.

    A column of ``df`` that has the name of one of these is replaced by it."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(READ + (", payload binary" if with_payload else ""))
    kept = [c for c in df.columns if c not in schema.names]
    out = StructType([df.schema[c] for c in kept] + schema.fields)

    def run(batches):
        for batch in pieces(batches):
            rows: dict[str, list] = {n: [] for n in schema.names if n != "keyframes"}
            keys = []
            for content in batch.column(column).to_pylist():
                track, why = Track(), None
                if content is None:
                    why = "no container"
                else:
                    try:
                        found = read_tracks(content)
                        track = next((t for t in found if t.handler == "vide"), found[0] if found else track)
                        why = None if found else "no track"
                    except (ValueError, struct.error) as e:
                        why = str(e)
                values = (track.codec, track.timescale, track.duration, track.width, track.height, len(track.sizes), why)
                for name, x in zip(("codec", "timescale", "duration", "width", "height", "n_samples", "error"), values, strict=True):
                    rows[name].append(x)
                i = track.keys - 1
                keys.append((track.offsets[i], track.sizes[i]))
                if with_payload:
                    rows["payload"].append(samples(content, track) if content is not None and why is None else None)
            made = {n: pa.array(x, pa.string() if n in ("codec", "error") else pa.binary() if n == "payload" else pa.int64()) for n, x in rows.items()}
            made["keyframes"] = _ranges(keys)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [made[n] for n in schema.names], names=kept + schema.names)

    return df.select(*[df[c] for c in kept]).mapInArrow(run, out)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text, reads it back, and gives the digests of both forms."""
    seen = read_media(store_media(docs), with_payload=True)
    last = F.col("keyframes")[F.size("keyframes") - 1]
    feature = F.concat_ws(
        ";", "codec", "timescale", "duration", F.concat_ws("x", "width", "height"), "n_samples", F.size("keyframes"),
        F.concat_ws("-", last["first"], last["first"] + last["length"]), F.hex(F.crc32(F.array_join(F.transform("keyframes", lambda k: k["first"]), ",").cast("binary"))),
    )
    return seen.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "codec", "duration", F.size("keyframes").alias("n_keyframes"),
    )

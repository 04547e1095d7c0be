"""Audio containers as tables: WAV samples, transport-stream demultiplexing, box order.

Other codecs are a boundary: register a decoder for a format, or get a clear error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .batches import pieces, small_batches

#: format -> function of bytes that yields (rate, channels, interleaved samples).
DECODERS: dict[str, Callable[[bytes], Iterator[tuple[int, int, np.ndarray]]]] = {}
CHUNKS = "source_id string, chunk_seq long, sample_rate int, channels int, samples array<float>"


class NoDecoder(RuntimeError):
    pass


def decoder(kind: str):
    def take(f):
        DECODERS[kind] = f
        return f

    return take


@decoder("wav")
def wav_chunks(data: bytes, frames: int = 4096) -> Iterator[tuple[int, int, np.ndarray]]:
    """PCM of 8, 16, 24 or 32 bits, or 32-bit floats."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data" and form:
            code, channels, rate, _, _, bits = form
            if code == 3 and bits == 32:
                x = np.frombuffer(body[: len(body) // 4 * 4], "<f4")
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            else:
                width = bits // 8
                raw = np.frombuffer(body[: len(body) // width * width], np.uint8).reshape(-1, width)
                wide = np.zeros((len(raw), 4), np.uint8)
                wide[:, 4 - width :] = raw
                x = wide.view("<i4").ravel().astype(np.float64) / 2**31
            step = frames * channels
            for i in range(0, len(x) // channels * channels, step):
                yield rate, channels, x[i : i + step].astype(np.float32)
        at += 8 + size + size % 2


def read_audio(spark: SparkSession, path: str, kind: str = "wav") -> DataFrame:
    """pcm_chunks of every non-empty file under a path."""
    if kind not in DECODERS:
        raise NoDecoder(f"no decoder is registered for {kind!r}")
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return decode(files, kind)


def decode(files: DataFrame, kind: str = "wav") -> DataFrame:
    """Of a table (path, content)."""
    if kind not in DECODERS:
        raise NoDecoder(f"no decoder is registered for {kind!r}")
    own = DECODERS[kind]

    def run(batches):
        for batch in pieces(batches, "content"):
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for i, (rate, channels, x) in enumerate(own(content)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([i], pa.int64()), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([x], pa.list_(pa.float32()))],
                        names=["source_id", "chunk_seq", "sample_rate", "channels", "samples"],
                    )

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, CHUNKS)


def transport_audio(data: bytes) -> bytes:
    """The first audio stream of a transport stream; ValueError, with a code, for what isn't one."""
    pid, counter, out = None, None, bytearray()
    if len(data) % 188:
        raise ValueError("DECODE_ERROR: not whole packets")
    for at in range(0, len(data), 188):
        p = data[at : at + 188]
        if p[0] != 0x47 or p[1] & 0x80:
            raise ValueError("DECODE_ERROR: lost sync")
        own, start, control = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3
        if control == 0 or p[3] & 0xC0:
            raise ValueError("UNSUPPORTED: scrambled")
        if control == 3 and p[4] > 183:
            raise ValueError("DECODE_ERROR: an adaptation field ends outside")
        body = p[4:] if control == 1 else p[5 + p[4] :] if control == 3 else b""
        if not body:
            continue
        if pid is None and start and body[:3] == b"\0\0\1" and 0xC0 <= body[3] <= 0xDF:
            pid = own
        if own != pid:
            continue
        if counter is not None and p[3] & 15 != (counter + 1) % 16:
            raise ValueError("DECODE_ERROR: continuity")
        counter = p[3] & 15
        if start and (len(body) < 9 or 9 + body[8] > len(body)):
            raise ValueError("DECODE_ERROR: a header ends outside")
        out += body[9 + body[8] :] if start else body
    if pid is None or not out:
        raise ValueError("UNSUPPORTED: no audio stream")
    return bytes(out)


def box_kinds(data: bytes) -> list[str]:
    out, at = [], 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("a header ends outside")
        size, kind = struct.unpack_from(">I4s", data, at)
        header = 8
        if size == 1 and at + 16 <= len(data):
            (size,), header = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = len(data) - at
        if size < header or at + size > len(data):
            raise ValueError("a box ends outside")
        out.append(kind.decode("latin-1"))
        at += size
    return out


def fragment_ok(data: bytes, init: bool) -> bool:
    """An init segment has ftyp and moov; a fragment has a moof before its mdat."""
    try:
        kinds = box_kinds(data)
    except ValueError:
        return False
    if init:
        return "ftyp" in kinds and "moov" in kinds
    return "moof" in kinds and "mdat" in kinds and kinds.index("moof") < kinds.index("mdat")


def fast_start(head: bytes, most: int = 4 << 20) -> str:
    """pending, progressive or artifact: a whole moov after ftyp and before mdat within the probe's bytes."""
    at, typed = 0, False
    while at < most and at + 8 <= len(head):
        size, kind = struct.unpack_from(">I4s", head, at)
        header = 8
        if size == 1:
            if at + 16 > len(head):
                return "pending"
            (size,), header = struct.unpack_from(">Q", head, at + 8), 16
        if size < header or kind == b"mdat" or at + size > most or (kind == b"moov" and not typed):
            return "artifact"
        if at + size > len(head):
            return "pending"
        if kind == b"moov":
            return "progressive"
        at, typed = at + size, typed or kind == b"ftyp"
    return "pending" if at < most else "artifact"

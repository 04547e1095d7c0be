"""Containers and codecs over tables of bytes: one row in, what it holds or a stable error code out.

Work is by Arrow batches; a row is a bounded object (a file, a segment, a chunk) and rows are independent, so nothing is
shuffled.  A null or empty body is an INVALID_SOURCE row and not a failed task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import containers
from .batches import pieces, small_batches

#: name -> function of a frame of interleaved samples that gives its packet.
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {}


def encoder(name: str):
    def take(f):
        ENCODERS[name] = f
        return f

    return take


@encoder("pcm16")
def pcm16(x: np.ndarray) -> bytes:
    return np.clip(np.floor(x.astype(np.float64) * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()


def each(df: DataFrame, column: str, made: str, f: Callable[[bytes], tuple]) -> DataFrame:
    """The columns of ``df`` but ``column``, and those that ``f`` makes of its bytes (DDL in ``made``), with error.

    ``f`` raises a ValueError that starts with an error code and a colon, or any other for DECODE_ERROR."""
    own = StructType.fromDDL(f"{made}, error string")
    kept = [c for c in df.columns if c != column and c not in own.names]
    out = StructType([df.schema[c] for c in kept] + own.fields)
    names = own.names[:-1]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in pieces(batches, column):
            rows: list[tuple] = []
            for body in batch.column(column).to_pylist():
                try:
                    if not body:
                        raise ValueError("INVALID_SOURCE: nothing there")
                    rows.append((*f(body), None))
                except (ValueError, IndexError) as e:
                    code = str(e).split(":")[0]
                    rows.append((*[None] * len(names), code if code.isupper() and " " not in code else "DECODE_ERROR"))
            columns = [batch.column(c) for c in kept] + [pa.array([r[i] for r in rows], arrow.field(n).type) for i, n in enumerate(own.names)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    small_batches(df.sparkSession)
    return df.select(*kept, column).mapInArrow(run, out)


def audio_files(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """path, content, error of the files under a path.  The reader passes over empty ones; with a table of the paths
    ``asked`` for, those that are empty or missing are INVALID_SOURCE."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if asked is None:
        return files.withColumn("error", F.lit(None).cast("string"))
    return asked.select("path").join(files, "path", "left").withColumn("error", F.when(F.col("content").isNull(), "INVALID_SOURCE"))


def decode_from(files: DataFrame, at_ms: str | None = None, kind: str = "wav", column: str = "content") -> DataFrame:
    """sample_rate, channels, first_frame and samples of each file, from a time on (``at_ms``: a column).

    The time is met to the frame; one past the end gives no samples."""
    if kind not in containers.DECODERS:
        raise containers.NoDecoder(f"no decoder is registered for {kind!r}")
    own = containers.DECODERS[kind]

    def whole(data: bytes) -> tuple:
        chunks = list(own(data))
        if not chunks:
            raise ValueError("DECODE_ERROR: no samples")
        return chunks[0][0], chunks[0][1], np.concatenate([x for _, _, x in chunks])

    out = each(files, column, "sample_rate int, channels int, samples array<float>", whole)
    first = F.call_function("div", (F.col(at_ms) if at_ms else F.lit(0)) * F.col("sample_rate"), F.lit(1000))
    out = out.withColumn("first_frame", F.least(first, F.size("samples") / F.col("channels")).cast("long"))
    return out.withColumn("samples", F.slice("samples", (F.col("first_frame") * F.col("channels") + 1).cast("int"), F.greatest(F.size("samples"), F.lit(0))))


def demultiplexed(segments: DataFrame, column: str = "content") -> DataFrame:
    """audio of each transport-stream segment."""
    return each(segments, column, "audio binary", lambda x: (containers.transport_audio(x),))


def probed(heads: DataFrame, column: str = "content") -> DataFrame:
    """boxes (their kinds in order), decision (pending, progressive or artifact), init_ok and fragment_ok of each head."""

    def look(data: bytes) -> tuple:
        try:
            kinds = containers.box_kinds(data)
        except ValueError:
            kinds = None
        return kinds, containers.fast_start(data), containers.fragment_ok(data, True), containers.fragment_ok(data, False)

    return each(heads, column, "boxes array<string>, decision string, init_ok boolean, fragment_ok boolean", look)


def encoded(frames: DataFrame, name: str, column: str = "samples") -> DataFrame:
    """packet of each frame, by a registered encoder."""
    if name not in ENCODERS:
        raise containers.NoDecoder(f"no encoder is registered for {name!r}")
    own = ENCODERS[name]
    out = StructType([f for f in frames.schema.fields if f.name not in (column, "packet")]).add("packet", "binary")
    kept = out.names[:-1]

    def run(batches):
        for batch in pieces(batches, column):
            packets = [None if x is None else own(np.array(x, np.float32)) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(packets, pa.binary())], names=[*kept, "packet"])

    small_batches(frames.sparkSession)
    return frames.select(*kept, column).mapInArrow(run, out)

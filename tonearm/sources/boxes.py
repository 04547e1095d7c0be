"""Boxes of files that come as chunks, cut anywhere.

Where a box begins is known only from the one before it, so a walk would go through a file in one task.  Here every place that
could be a header is a candidate (four printable characters after a length), each points to where its box ends, and pointers are
doubled: after k rounds all boxes are known that lie 2^k from the start.  Headers that two or more chunks share are read from
blocks, which have the bytes that follow them.  A task holds a block; a round is two joins by (file, place).

A box's kind is four printable characters (or one that begins with a copyright sign); anything else where a header should be is an
error row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import checks as C
from ..functions import numbers as N
from ..functions import rules as R
from ..operators.scans import scan, written
from . import tables as T

#: Bytes of a block, of a header at most, and those that a fast start is looked for in.
BLOCK, HEADER, PROBE = 1 << 20, 16, 4 << 20


def header_at(data: bytes, i: int) -> tuple[int, int, str] | None:
    """header, size (0: to the end of the file) and kind of what could be a header at a place."""
    if i + 8 > len(data):
        return None
    size, kind, header = int.from_bytes(data[i : i + 4], "big"), data[i + 4 : i + 8], 8
    if not all(32 <= c < 127 or (c == 0xA9 and j == 0) for j, c in enumerate(kind)):
        return None
    if size == 1:
        if i + HEADER > len(data):
            return None
        size, header = min(int.from_bytes(data[i + 8 : i + 16], "big"), 1 << 62), HEADER
    return (header, size, kind.decode("latin-1")) if size >= header or (size == 0 and header == 8) else None


def find(data: bytes, base: int, own: int, total: int) -> list[tuple[int, int, int, str]]:
    """(place, header, size, kind) of what could be a box at one of the first ``own`` bytes, and ends in the file."""
    x = np.frombuffer(data, np.uint8)
    n = min(own, len(x) - 7)
    if n <= 0:
        return []
    plain = (x >= 32) & (x < 127)
    ok = (plain[4 : n + 4] | (x[4 : n + 4] == 0xA9)) & plain[5 : n + 5] & plain[6 : n + 6] & plain[7 : n + 7]
    size = x[:n].astype(np.int64) << 24 | x[1 : n + 1].astype(np.int64) << 16 | x[2 : n + 2].astype(np.int64) << 8 | x[3 : n + 3]
    ok &= size <= total - base - np.arange(n)
    out = []
    for i in np.flatnonzero(ok).tolist():
        if (h := header_at(data, i)) is not None and base + i + h[1] <= total:
            out.append((base + i, *h))
    return out


def boxes(chunks: DataFrame, key: str, order: list[str], body: str = "content", block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """key, at, header, size, ends, kind, total (bytes there are) of each box of each file, in chunks in order; kind is null where a header
    should be and none is, and size is null where the box goes past what there is.

    Null and empty chunks have no bytes; a file without bytes has no rows."""
    own = chunks.select(key, *[c for c in order if c != key], F.coalesce(F.col(body), F.lit(b"")).alias("_x")).withColumn("_n", F.octet_length("_x").cast("long")).where("_n > 0")
    placed = scan(own, [key], order, sums={"_to": F.col("_n")}, buckets=buckets).withColumn("_at", F.col("_to") - F.col("_n"))
    totals = written(placed.groupBy(key).agg(F.max("_to").alias("total")))
    # Blocks, each with the bytes of a header after it.
    first = F.greatest(N.idiv(F.col("_at") - HEADER + 1, block), F.lit(0).cast("long"))
    dealt = placed.withColumn("block", F.explode(F.sequence(first, N.idiv(F.col("_to") - 1, block))))
    low = F.greatest(F.col("block") * block - F.col("_at"), F.lit(0))
    high = F.least((F.col("block") + 1) * block + HEADER - 1 - F.col("_at"), F.col("_n"))
    cut = dealt.where(low < high).select(key, "block", (F.col("_at") + low).alias("_at"), F.substring("_x", (low + 1).cast("int"), (high - low).cast("int")).alias("_x"))
    whole = cut.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_p"))  # a block's own
    whole = whole.select(key, "block", F.transform("_p", lambda p: p["_x"]).alias("_x")).join(totals, key)
    made = StructType([chunks.schema[key], *StructType.fromDDL("at long, header long, size long, kind string").fields])

    def each(look):
        """Rows that ``look`` gives of a block's number, bytes and another column."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, rows = [], []
                for i, (b, x, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "_x", "_o")), strict=True)):
                    found = look(b, b"".join(x), other)
                    rows += found
                    places += [i] * len(found)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(places)), *columns], names=made.names)

        return run

    found = whole.withColumn("_o", F.col("total")).mapInArrow(each(lambda b, x, total: find(x, b * block, block, total)), made).join(totals, key)
    size = F.when(F.col("size") == 0, F.col("total") - F.col("at")).otherwise(F.col("size"))
    found = written(found.withColumn("size", size).withColumn("_next", F.col("at") + size))
    jump = found.select(key, "at", F.col("_next").alias("next"))
    reached = written(totals.select(key, F.lit(0).cast("long").alias("at")))
    known = reached.count()
    while True:
        new = reached.join(jump, [key, "at"]).select(key, F.col("next").alias("at"))
        reached = written(reached.unionByName(new).distinct())
        if (now := reached.count()) == known:
            break
        known = now
        on = jump.select(F.col(key).alias("_k"), F.col("at").alias("_a"), F.col("next").alias("_n"))
        jump = written(jump.join(on, (F.col(key) == F.col("_k")) & (F.col("next") == F.col("_a")), "left").select(key, "at", F.coalesce("_n", "next").alias("next")))
    every = reached.join(totals, key).where("at < total").join(found.drop("total", "_next"), [key, "at"], "left")
    every = written(every)
    # Where a walk stops there may be a box that goes past the end: one place a file, looked up in its block.
    last = every.where("header IS NULL").select(F.col(key).alias("_k"), F.col("at").alias("_o"), N.idiv(F.col("at"), block).alias("_b"))
    at_end = whole.join(last, (F.col(key) == F.col("_k")) & (F.col("block") == F.col("_b")))
    look = lambda b, x, at: [(at, *h)] if (h := header_at(x, at - b * block)) else []
    open_ = at_end.mapInArrow(each(look), made).select(key, "at", F.col("header").alias("_h"), F.col("size").alias("_s"), F.col("kind").alias("_kind"))
    out = every.join(open_, [key, "at"], "left")
    size = F.coalesce("size", "_s")
    return out.select(
        key, "at", F.coalesce("header", "_h").alias("header"), F.when(F.col("at") + size <= F.col("total"), size).alias("size"), (F.col("at") + size).alias("ends"), F.coalesce("kind", "_kind").alias("kind"), "total"
    )


def fragments(found: DataFrame, key: str) -> DataFrame:
    """key, box_error, moof_at, mdat_at, first_box, init_error, fragment_error of each file's boxes."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    out = found.groupBy(key).agg(
        F.bool_or(F.col("size").isNull()).alias("box_error"), at("moof").alias("moof_at"), at("mdat").alias("mdat_at"), at("ftyp").alias("_ftyp"), at("moov").alias("_moov"), F.min_by("kind", "at").alias("first_box")
    )
    broken = F.when(F.col("box_error"), "DECODE_ERROR")
    init = F.coalesce(broken, F.when(F.col("_ftyp").isNull() | F.col("_moov").isNull(), "INVALID_SOURCE"))
    fragment = F.coalesce(broken, F.when(~F.coalesce(F.col("moof_at") < F.col("mdat_at"), F.lit(False)), "INVALID_SOURCE"))
    return out.select(key, "box_error", "moof_at", "mdat_at", "first_box", init.alias("init_error"), fragment.alias("fragment_error"))


def fast_starts(found: DataFrame, key: str, most: int = PROBE) -> DataFrame:
    """key, decision of each head of a file: progressive when a whole moov comes after ftyp and before mdat within ``most`` bytes,
    artifact when that can't be any more, and pending while more bytes could tell.

    A box that goes to the end of its file can't be told from its head, so it is an artifact, as is what is no box."""
    ftyp = F.min(F.when(F.col("kind") == "ftyp", F.col("at"))).over(Window.partitionBy(key))
    end, kind = F.col("ends"), F.col("kind")
    short = F.col("total") - F.col("at") < 8
    verdict = (
        F.when(F.col("at") >= most, "artifact").when(short, "pending").when(kind.isNull() | (kind == "mdat") | (end > most), "artifact")
        .when((kind == "moov") & ~F.coalesce(ftyp < F.col("at"), F.lit(False)), "artifact").when(F.col("size").isNull(), F.when(F.col("total") >= most, "artifact").otherwise("pending")).when(kind == "moov", "progressive")
    )
    own = found.withColumn("_verdict", verdict)
    return own.groupBy(key).agg(F.coalesce(F.min_by("_verdict", F.when(F.col("_verdict").isNotNull(), F.col("at"))), F.when(F.max("total") >= most, "artifact").otherwise("pending")).alias("decision"))


def normalized(segments: DataFrame, key: str, url: str = "url", mapped: str = "mapped", body: str = "content") -> DataFrame:
    """key, kind, audio, error of each segment's bytes: fragments of a mapped playlist are checked, transport streams
    demultiplexed, bare fragments refused, and the rest is told by its first bytes."""
    own = segments.select(key, F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(F.col(mapped), F.lit(False)).alias("_mapped"), F.coalesce(F.col(body), F.lit(b"")).alias("_x"))
    own = own.withColumn("_ts", ~F.col("_mapped") & C.is_transport(F.col("_x"), F.col("_url")))
    walked = fragments(boxes(own.where("_mapped").select(key, F.lit(0).alias("_i"), "_x"), key, ["_i"], "_x"), key)
    streams = T.demultiplexed(own.where("_ts").select(key, F.col("_x").alias("content")), "content").select(key, F.col("audio").alias("_audio"), F.col("error").alias("_ts_error"))
    met = own.join(walked, key, "left").join(streams, key, "left")
    bare = F.decode(F.substring("_x", 5, 4), "ISO-8859-1")
    audio = F.when(F.col("_ts"), F.col("_audio")).otherwise(F.col("_x"))
    kind, error = C.segment_kind(F.col("_mapped"), F.coalesce("box_error", F.lit(False)), F.col("moof_at"), F.col("mdat_at"), F.col("_ts"), R.elementary_kind(audio), F.when(F.octet_length("_x") >= 8, bare))
    error = F.coalesce(F.when(F.col("_ts"), F.col("_ts_error")), error)
    return met.select(key, F.when(error.isNull(), kind).alias("kind"), F.when(error.isNull(), audio).alias("audio"), error.alias("error"))

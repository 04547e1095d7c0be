"""Sample-rate conversion of streams that come in chunks.

An output frame needs 65 input frames on either side, which may be many chunks away or one.  So chunks are placed by the frames
before them (a scan that holds for streams of any length), cut into blocks of the stream with a halo on either side, and a block
is converted by itself: the result is that of the whole stream at once, however it was cut.  A stream of n frames gives
ceil(n * target / source), aligned with its first frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import numbers as N
from .scans import scan

#: Taps, table entries a frame, and the cutoff's fit for the squared Blackman window.
TAPS, OVERSAMPLING = 128, 256
CUTOFF_FIT = (9.506235102129398, 79.13120634953742, 1502.2316160588925)
#: Frames of a block, and those that it takes from its neighbours.
BLOCK, HALO = 4096, TAPS // 2 + 2
#: Phases whose taps are kept as a table; of finer ratios they are made for each block.
MOST_PHASES = 4096
OFFSETS = np.arange(-HALO + 1, HALO)


def cutoff(taps: int = TAPS) -> float:
    """The share of the band that passes: what is left when the filter must be down at its end."""
    a, b, c = CUTOFF_FIT
    return 1 / (1 + a / taps + b / taps**2 + c / taps**3)


@lru_cache(maxsize=8)
def table(cut: float) -> np.ndarray:
    """A sinc under a squared Blackman window at every 1/OVERSAMPLING of a frame, with unit gain, and zeros about it."""
    half = TAPS // 2
    d = np.arange(-half * OVERSAMPLING, half * OVERSAMPLING) / OVERSAMPLING
    u = np.pi * d / half
    y = np.sinc(cut * d) * (0.42 + 0.5 * np.cos(u) + 0.08 * np.cos(2 * u)) ** 2
    room = np.zeros((HALO + 2 - half) * OVERSAMPLING)
    return np.concatenate([room, y * OVERSAMPLING / y.sum(), room])


def taps(fraction: np.ndarray, cut: float) -> np.ndarray:
    """The weights of the frames at OFFSETS for places so far past a frame, by a parabola through three entries of the table."""
    at = np.floor(fraction * OVERSAMPLING)
    x = (fraction * OVERSAMPLING - at)[:, None]
    entry = at.astype(np.int64)[:, None] + (HALO + 2 - OFFSETS) * OVERSAMPLING
    y0, y1, y2 = (table(cut)[entry + i] for i in range(3))
    return y0 + (-3 * y0 + 4 * y1 - y2) / 2 * x + (y0 - 2 * y1 + y2) / 2 * x * x


@lru_cache(maxsize=8)
def phases(source: int, target: int) -> np.ndarray:
    p = target // gcd(source, target)
    return taps(np.arange(p) / p, cutoff() * min(1.0, target / source))


def converted(x: np.ndarray, first: int, low: int, high: int, source: int, target: int) -> tuple[int, np.ndarray]:
    """The outputs that fall on input frames low to high - 1: the first one's number, and the frames.

    ``x`` has the input frames from ``first`` on (frames x channels); what it lacks is silence."""
    g = gcd(source, target)
    p, q = target // g, source // g
    k0, k1 = -(-low * p // q), -(-high * p // q)
    k = np.arange(k0, k1)
    frame, phase = k * q // p, k * q % p
    lead, trail = HALO - 1 - (low - first), HALO - (first + len(x) - high)
    x = np.pad(x, ((max(0, lead), max(0, trail)), (0, 0)))[max(0, -lead) :]
    weights = phases(source, target)[phase] if p <= MOST_PHASES else taps(phase / p, cutoff() * min(1.0, target / source))
    seen = np.lib.stride_tricks.sliding_window_view(x, 2 * HALO - 1, axis=0)[frame - low]
    return k0, np.einsum("kct,kt->kc", seen, weights)


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """A whole stream at once (frames, or frames x channels)."""
    x = np.asarray(x, np.float64)
    if source == target or not len(x):
        return x
    return converted(x.reshape(len(x), -1), 0, 0, len(x), source, target)[1].reshape(-1, *x.shape[1:])


def resampled(chunks: DataFrame, key: list[str], order: list[str], target: int, channels: int = 1, rate: str = "sample_rate", column: str = "samples", block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """key, block, position (of its first output frame), samples (interleaved) and error of each stream at the target rate.

    Null and empty chunks have no frames; a stream at the target rate passes as it is.  A chunk at another rate than its stream
    had, or with a part of a frame, ends the stream with a RESAMPLE_ERROR row; what came before it is converted."""
    size = F.coalesce(F.when(F.size(column) >= 0, F.size(column)), F.lit(0)).cast("long")
    own = chunks.select(*key, *[c for c in order if c not in key], F.col(rate).cast("long").alias("_rate"), F.col(column).cast("array<double>").alias("_x"), size.alias("_n"))
    odd = F.when(F.col("_n") % channels != 0, 1).otherwise(0)
    heard = F.when(F.col("_n") > 0, F.col("_rate"))
    placed = scan(own, key, order, sums={"_to": F.col("_n")}, maxima={"_most": heard, "_least": -heard, "_odd": odd}, buckets=buckets)
    before = (F.col("_most") != -F.col("_least")) | (F.col("_odd") == 1)
    now = ((F.col("_n") > 0) & (F.col("_rate") != F.col("_most"))) | (odd == 1)
    ended, ends = F.coalesce(before, F.lit(False)), F.coalesce(now, F.lit(False))
    failed = placed.where(~ended & ends).select(*key, F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("array<double>").alias("samples"), F.lit("RESAMPLE_ERROR").alias("error"))
    good = placed.where(~ended & ~ends & (F.col("_n") > 0)).select(*key, "_rate", "_x", (F.col("_to") - F.col("_n")).alias("_at"), F.col("_n"))
    # Cut at the edges of blocks, each with its halo.
    width, halo = block * channels, HALO * channels
    n_block = F.sequence(F.greatest(N.idiv(F.col("_at") - halo, width), F.lit(0)).cast("long"), N.idiv(F.col("_at") + F.col("_n") - 1 + halo, width))
    dealt = good.withColumn("block", F.explode(n_block))
    low = F.greatest(F.col("block") * width - halo - F.col("_at"), F.lit(0))
    high = F.least((F.col("block") + 1) * width + halo - F.col("_at"), F.col("_n"))
    cut = dealt.where(low < high).select(*key, "block", "_rate", (F.col("_at") + low).alias("_at"), F.slice("_x", (low + 1).cast("int"), (high - low).cast("int")).alias("_x"))
    pieces = F.array_sort(F.collect_list(F.struct("_at", "_x")))  # a block's own
    whole = cut.groupBy(*key, "block").agg(F.first("_rate").alias("_rate"), F.min("_at").alias("_at"), pieces.alias("_p"))
    whole = whole.select(*key, "block", "_rate", "_at", F.flatten(F.transform("_p", lambda p: p["_x"])).alias("_x"))
    made = StructType([f for f in whole.schema.fields if f.name in key] + StructType.fromDDL("block long, position long, samples array<double>, error string").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x")
            ends_, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
            rates, blocks, firsts = (batch.column(c).to_numpy() for c in ("_rate", "block", "_at"))
            position, out = [], []
            for i in range(batch.num_rows):
                frames = flat[ends_[i] : ends_[i + 1]].reshape(-1, channels)
                first, b = int(firsts[i]) // channels, int(blocks[i])
                low, high = b * block, min((b + 1) * block, first + len(frames))
                if high <= low:  # a halo past the stream's end
                    at, y = 0, frames[:0]
                elif rates[i] == target:
                    at, y = low, frames[low - first : high - first]
                else:
                    at, y = converted(frames, first, low, high, int(rates[i]), target)
                position.append(at)
                out.append(y.ravel())
            lengths = np.concatenate([[0], np.cumsum([len(y) for y in out])]).astype(np.int32)
            samples = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(out) if out else np.zeros(0)))
            columns = [*[batch.column(k) for k in key], batch.column("block"), pa.array(position, pa.int64()), samples, pa.nulls(batch.num_rows, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=made.names)

    return whole.mapInArrow(run, made).where("size(samples) > 0").unionByName(failed)

"""Functions of interleaved sample arrays, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import hard_gain, lit, soft_limit


def mono_to_stereo(s: Column) -> Column:
    return F.flatten(F.transform(s, lambda x: F.array(x, x)))


def downmix(s: Column, channels: int) -> Column:
    """To stereo: the first two channels plus half the mean of the others; null unless the length divides."""
    if channels == 1:
        return mono_to_stereo(s)
    if channels == 2:
        return F.when(F.size(s) % 2 == 0, s)
    share = 0.5 / (channels - 2)

    def frame(i: Column) -> Column:
        rest = F.aggregate(F.slice(s, i * channels + 3, channels - 2), F.lit(0.0), lambda a, x: a + x.cast("double")) * share
        at = lambda c: F.greatest(F.least(F.get(s, i * channels + c).cast("double") + rest, F.lit(1.0)), F.lit(-1.0))
        return F.array(at(0), at(1))

    frames = F.when(F.size(s) >= channels, F.sequence(F.lit(0), (F.size(s) / channels).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(s) % channels == 0, F.flatten(F.transform(frames, frame)))


def peak(s: Column) -> Column:
    """The largest magnitude; 0 for no samples."""
    return F.coalesce(F.array_max(F.transform(s, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def in_range(s: Column) -> Column:
    """Every sample finite and within one."""
    return F.forall(s, lambda x: ~F.isnan(x) & (F.abs(x) <= 1))


def apply_volume(s: Column, gain, limiter=True) -> Column:
    """Zero gain gives silence, unit gain leaves samples in range alone, and above one the soft limiter holds if it is on."""
    g = lit(gain)
    return (
        F.when(g == 0, F.transform(s, lambda x: F.lit(0.0)))
        .when((g == 1) & in_range(s), F.transform(s, lambda x: x.cast("double")))
        .when((g > 1) & lit(limiter), F.transform(s, lambda x: soft_limit(x.cast("double") * g)))
        .otherwise(F.transform(s, lambda x: hard_gain(x.cast("double"), g)))
    )


def pad_to(s: Column, length: int) -> Column:
    """Zeros at the end up to a length."""
    return F.when(F.size(s) >= length, s).otherwise(F.concat(s, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(s))))


def trim(s: Column, channels: int, start: Column, end: Column) -> Column:
    """Drops frames at either end, no more than there are."""
    frames = (F.size(s) / channels).cast("int")
    first = F.least(start, frames)
    kept = F.greatest(frames - first - end, F.lit(0))
    return F.slice(s, first * channels + 1, kept * channels)


def resampled_length(frames: Column, source: int, target: int) -> Column:
    """Frames that a whole conversion gives."""
    from .numbers import idiv

    return idiv(frames * target + (source - 1), source)

"""Scalar functions of media streams, as Column builders.

All run inside Catalyst.  Integers follow the wire's widths: wrapping ones take
pmod after each step, saturating ones are held at the limits of 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U16, U32 = 1 << 16, 1 << 32
I64 = (1 << 63) - 1
SAMPLE_RATE, FRAME_SAMPLES, CHANNELS = 48_000, 960, 2
SILENCE_DBFS = -120.0


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bound(x: Column, f) -> Column:
    """f of a column that is computed once, and stands in the plan once."""
    return F.get(F.transform(F.array(x), f), 0)


def rounded(x: Column, digits: int) -> Column:
    """A double to so many decimals, ties away from zero, as SQL's round has it: what is negative and comes to zero is -0.0, whose
    sign F.round drops."""

    def whole(v: Column) -> Column:
        near = F.rint(v)
        return F.when(F.abs(v - near) == 0.5, v + F.signum(v) * 0.5).otherwise(near)

    return bound(x * 10.0**digits, whole) / 10.0**digits


def clamp(x: Column, low, high) -> Column:
    """Between two limits; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, lit(high)), lit(low)))


def idiv(a, b) -> Column:
    """Integer quotient, truncated, as a long; null for a zero divisor."""
    return F.call_function("div", lit(a).cast("long"), F.nullif(lit(b).cast("long"), F.lit(0).cast("long")))


def wrap(x: Column, width: int = U32) -> Column:
    return F.pmod(x, F.lit(width))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a.cast("long"), b.cast("long")), F.when(a.isNotNull() & b.isNotNull(), F.lit(I64)))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def dbfs(amplitude: Column) -> Column:
    """20 log10 of an amplitude, no less than -120, which also stands for silence and non-finite values."""
    a = amplitude.cast("double")
    bad = F.isnan(a) | (a <= 0) | (a == float("inf"))
    return F.when(bad, F.lit(SILENCE_DBFS)).otherwise(F.greatest(F.lit(20.0) * F.log10(F.when(~bad, a)), F.lit(SILENCE_DBFS)))


def volume_db(unit: Column, min_db: float = -60.0, curve: float = 0.5, extra: float = 0.0) -> Column:
    """Perceptual volume in dB; muted is minus infinity."""
    return F.when(unit <= 0, F.lit(float("-inf"))).otherwise(F.lit(min_db) - F.lit(min_db) * F.pow(unit, F.lit(curve)) + F.lit(extra))


def volume_units(unit: Column) -> Column:
    """A volume as ten-thousandths."""
    return F.round(unit * 10_000.0).cast("int")


def gain_centibels(db: Column) -> Column:
    return F.round(clamp(db, -60.0, 12.0) * 100.0).cast("int")


def soft_limit(x: Column, knee: float = 0.95) -> Column:
    """The identity up to the knee; beyond it an exponential approach to one."""
    a, room = F.abs(x), 1.0 - knee
    over = F.least(F.lit(knee) + F.lit(room) * (F.lit(1.0) - F.exp(-(a - knee) / room)), F.lit(1.0))
    return F.when(a <= knee, x).otherwise(F.signum(x) * over)


def hard_gain(x: Column, gain) -> Column:
    return clamp(x * lit(gain), -1.0, 1.0)


def duration_ms(samples: Column, rate) -> Column:
    """Whole milliseconds; 0 at rate 0."""
    r = lit(rate)
    return F.when(r == 0, F.lit(0)).otherwise(idiv(samples * 1000, F.when(r != 0, r))).cast("long")


def samples_of_micros(micros: Column, rate: int = SAMPLE_RATE) -> Column:
    return idiv(micros * rate, 1_000_000)


def jitter_micros(jitter: Column, clock: int = SAMPLE_RATE) -> Column:
    return idiv(jitter * 1_000_000, clock)


def compact_micros(duration: Column) -> Column:
    """Of a duration in 1/65536 seconds."""
    return idiv(duration * 1_000_000, 65_536)


def round_trip_micros(arrival: Column, last_report: Column, delay: Column) -> Column:
    """Null without a last report, or when the delay exceeds the time elapsed (both wrap at 32 bits)."""
    elapsed = wrap(arrival - last_report)
    return F.when((last_report != 0) & (elapsed >= delay), compact_micros(elapsed - delay))


NTP_EPOCH = 2_208_988_800


def ntp_seconds(unix_micros: Column) -> Column:
    return wrap(idiv(unix_micros, 1_000_000) + NTP_EPOCH)


def ntp_fraction(unix_micros: Column) -> Column:
    return idiv((unix_micros % 1_000_000) * U32, 1_000_000)


def ntp_compact(unix_micros: Column) -> Column:
    """The middle 32 bits of the 64-bit time stamp."""
    return (ntp_seconds(unix_micros) % U16) * U16 + idiv(ntp_fraction(unix_micros), U16)


def loss_percent(fraction: Column) -> Column:
    return fraction * 100.0 / 256.0


def quality_level(loss: Column, jitter: Column, rtt: Column) -> Column:
    """poor, degraded or good from mean loss in percent, highest jitter and mean round trip in microseconds."""
    rtt = F.coalesce(rtt, F.lit(0))
    return (
        F.when((loss >= 10) | (jitter >= 80_000) | (rtt >= 500_000), "poor")
        .when((loss >= 2) | (jitter >= 30_000) | (rtt >= 200_000), "degraded")
        .otherwise("good")
    )


def reload_delay_ms(target_seconds: Column) -> Column:
    return F.greatest(F.least(target_seconds * 500, F.lit(5000)), F.lit(500))


def quota_units(size: Column, unit: int = 1 << 20) -> Column:
    return idiv(size + (unit - 1), unit)


def payload_limit(output: Column, mtu: Column) -> Column:
    return F.when(output == "rtp", mtu - 12).otherwise(F.lit(1500))


def coverage_ratio(packets: Column, streams: Column, seconds: Column) -> Column:
    """Packets against fifty a second; three decimals, 0 without time."""
    all_ = streams * seconds * 50.0
    return F.when(seconds > 0, F.round(packets / F.when(all_ != 0, all_) * 1000) / 1000).otherwise(F.lit(0.0))


def replay_gain(track_gain, album_gain, track_peak, album_peak, album_mode=False, preamp=0.0, target_peak=0.0, prevent_clipping=True, fallback=True) -> Column:
    """A struct: source, requested_db, gain_db, clipping_limited, range_limited; null where no gain is to be had.

    The chosen side's gain plus the preamp is held under what brings its peak to the target, then to -60..12 dB
    and to hundredths of a decibel."""
    sides = [("track", lit(track_gain), lit(track_peak)), ("album", lit(album_gain), lit(album_peak))]
    first, second = sides[::-1] if album_mode else sides
    # Each step is computed once and bound, so the plan holds it once.
    choice = lambda name, side: F.struct(F.lit(name).alias("source"), side[0].cast("double").alias("gain"), side[1].cast("double").alias("peak"))
    chosen = F.when(first[1].isNotNull(), choice(first[0], first[1:])).when(second[1].isNotNull() & lit(fallback), choice(second[0], second[1:]))

    def limited(c: Column) -> Column:
        asked = c["gain"] + lit(preamp)
        most = F.when(c["peak"].isNotNull() & lit(prevent_clipping), lit(target_peak) - dbfs(c["peak"]))
        return bound(F.struct(c["source"].alias("source"), asked.alias("asked"), most.alias("most")), capped)

    def capped(c: Column) -> Column:
        clipped = F.coalesce(c["asked"] > c["most"], F.lit(False))
        return bound(F.struct(c["source"].alias("source"), c["asked"].alias("asked"), clipped.alias("clipped"), F.when(clipped, c["most"]).otherwise(c["asked"]).alias("gain")), ranged)

    def ranged(c: Column) -> Column:
        held = clamp(c["gain"], -60.0, 12.0)
        return F.struct(
            c["source"].alias("source"), c["asked"].alias("requested_db"), (F.round(held * 100) / 100).alias("gain_db"), c["clipped"].alias("clipping_limited"), (F.abs(held - c["gain"]) > 1e-4).alias("range_limited"),
        )

    return F.when(first[1].isNotNull() | (second[1].isNotNull() & lit(fallback)), bound(chosen, limited))


def hex_bytes(x: Column, width: int) -> Column:
    """An unsigned integer as big-endian bytes in hex."""
    return F.lower(F.lpad(F.hex(x), 2 * width, "0"))


def rtp_header(marker: Column, payload_type: int, sequence: Column, timestamp: Column, ssrc: Column) -> Column:
    """The twelve bytes of a version-2 header."""
    second = F.when(marker, F.lit(128 + payload_type)).otherwise(F.lit(payload_type))
    return F.unhex(F.concat(F.lit("80"), hex_bytes(second, 1), hex_bytes(wrap(sequence, U16), 2), hex_bytes(wrap(timestamp), 4), hex_bytes(wrap(ssrc), 4)))


def rtp_packet(payload: Column, mtu: int, **header) -> Column:
    """Null when the payload is empty or doesn't fit."""
    size = F.octet_length(payload)
    return F.when((size > 0) & (size <= mtu - 12), F.concat(rtp_header(**header), payload))


def error_text(code: Column, message: Column) -> Column:
    return F.concat_ws(": ", code, message)


def report_percent_ms(fraction: Column, jitter_us: Column, rtt_us: Column) -> Column:
    """A receiver report as it is handed out: loss in percent, jitter and round trip in milliseconds."""
    return F.struct(loss_percent(fraction).alias("loss_percent"), (jitter_us / 1000.0).alias("jitter_ms"), (rtt_us / 1000.0).alias("rtt_ms"))


def capped_u32(x: Column) -> Column:
    return F.least(x, F.lit(U32 - 1))


def projected_rtp(rtp: Column, at_micros: Column, now_micros: Column, rate: int = SAMPLE_RATE) -> Column:
    """The RTP time that stands for now, from one that stood for an instant before."""
    return wrap(rtp + samples_of_micros(F.greatest(now_micros - at_micros, F.lit(0)), rate))


def volume_error(unit: Column) -> Column:
    return F.when(F.isnan(unit) | ~unit.between(0, 1) | unit.isNull(), "INVALID_CONFIG")


def gain_error(db: Column) -> Column:
    return F.when(F.isnan(db) | ~db.between(-60, 12) | db.isNull(), "INVALID_CONFIG")


def http_error_code(status: Column, timeout: Column) -> Column:
    return F.when(timeout, "SOURCE_TIMEOUT").when(status.isin(401, 403), "SOURCE_AUTH_EXPIRED").otherwise("INVALID_SOURCE")


def http_retryable(status: Column, timeout: Column) -> Column:
    return F.coalesce(timeout, F.lit(False)) | status.isNull() | status.isin(408, 429) | status.between(500, 599)

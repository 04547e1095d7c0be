"""Checks of configurations and of host input, and small mappings, as Column builders.

A check gives null for good values, or a stable error code.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers as N
from .rules import INVALID_CONFIG, INVALID_SOURCE, UNSUPPORTED, any_of

F32_MAX = 3.4028234663852886e38
MIB = 1 << 20
#: Error names and their wire codes.
ERROR_CODES = {
    "StreamNotFound": "STREAM_NOT_FOUND", "StreamAlreadyExists": "STREAM_ALREADY_EXISTS", "InvalidConfig": "INVALID_CONFIG", "InvalidSource": "INVALID_SOURCE",
    "DetectedLiveSource": "UNSUPPORTED", "DetectedHlsSource": "UNSUPPORTED", "SourceTimeout": "SOURCE_TIMEOUT", "SourceAuthExpired": "SOURCE_AUTH_EXPIRED",
    "Unsupported": "UNSUPPORTED", "Busy": "BUSY", "StreamClosed": "STREAM_CLOSED", "NotSeekable": "NOT_SEEKABLE", "DecodeError": "DECODE_ERROR",
    "ResampleError": "RESAMPLE_ERROR", "EncodeError": "ENCODE_ERROR", "RtpOutputError": "OUTPUT_ERROR", "ExternalPullError": "OUTPUT_ERROR", "Internal": "INTERNAL",
}
#: Outcomes of a pulled frame.
OUTCOMES = ("sent", "late", "cancelled", "outputUnavailable")


def mapped(x: Column, table: Mapping[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())]), x)


def invalid(*bad: Column, code: str = INVALID_CONFIG) -> Column:
    return F.when(any_of(*bad), code)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def error_code(name: Column) -> Column:
    return mapped(name, ERROR_CODES)


def codec_error(name: Column) -> Column:
    """Of a demuxer's or resampler's error."""
    return F.when(name == "seek", "NOT_SEEKABLE").when(name == "resampler", "RESAMPLE_ERROR").otherwise("DECODE_ERROR")


# Configurations.


def runtime(bitrate, live_buffer, live_budget, http_bytes, tempfile_bytes, rtcp_ms, start_timeout_ms) -> Column:
    units = N.idiv(http_bytes + (MIB - 1), MIB)
    return invalid(
        ~bitrate.between(500, 512_000), live_buffer > live_budget, units > N.idiv(N.idiv(tempfile_bytes, MIB), 4), rtcp_ms <= 0, ~start_timeout_ms.between(1, 15 * 60_000)
    )


def replay_gain(track_peak, album_peak, target_dbfs) -> Column:
    odd = lambda p: p.isNotNull() & ~(finite(p) & (p > 0))
    return invalid(odd(track_peak), odd(album_peak), ~(finite(target_dbfs) & (target_dbfs <= 0)))


def volume(min_db, curve, extra_db) -> Column:
    return invalid(~(finite(min_db) & (min_db < 0)), ~(finite(curve) & (curve > 0)), ~(finite(extra_db) & extra_db.between(-60, 12)))


def pipeline(generation, rate, channels, frame_samples, batch_ms) -> Column:
    frame_ms = N.idiv(frame_samples * 1000, rate)
    return invalid(*[x <= 0 for x in (generation, rate, channels, frame_samples, batch_ms)], frame_ms <= 0, frame_ms > batch_ms)


def chunk(rate, channels, want_rate, want_channels) -> Column:
    return F.when((rate != want_rate) | (channels != want_channels), "DECODE_ERROR")


def http_source(timeout_ms, max_bytes, retries, backoff_ms) -> Column:
    return invalid(timeout_ms <= 0, max_bytes <= 0, max_bytes > ((1 << 32) - 1) * MIB, (retries > 0) & (backoff_ms <= 0))


def live_source(open_ms, idle_ms, buffered, retries, backoff_ms) -> Column:
    return invalid(open_ms <= 0, idle_ms <= 0, buffered <= 0, (retries > 0) & (backoff_ms <= 0))


def resampler(rate, channels, chunk_frames, ratio, sinc_len, oversampling) -> Column:
    return invalid(*[x <= 0 for x in (rate, channels, chunk_frames, sinc_len, oversampling)], ratio <= 1.0)


def stream_id(id_: Column) -> Column:
    return invalid(F.trim(F.coalesce(id_, F.lit(""))) == "", F.octet_length(id_) > 512)


def status_batch(ids: Column) -> Column:
    return status_batch_of(F.size(ids))


def status_batch_of(n: Column) -> Column:
    """The same of a number of ids that are not at hand."""
    return invalid(n > 4096)


# Host input.


def port(value: Column, zero: bool = False) -> Column:
    return invalid(~value.between(0 if zero else 1, 65_535))


def u8(value: Column) -> Column:
    return invalid(~value.between(0, 255))


def f32(value: Column) -> Column:
    return invalid(~finite(value), F.abs(value) > F32_MAX)


def format_hint(hint: Column) -> tuple[Column, Column]:
    """The trimmed, lowered hint, and its error."""
    own = F.trim(hint)
    good = own.rlike(r"^[A-Za-z0-9]{1,16}\z")
    return F.when(good, F.lower(own)), F.when(hint.isNotNull() & ~good, INVALID_SOURCE)


#: Playout buffers where the host gives none, in milliseconds.
BUFFER_DEFAULTS = {"decode_batch_ms": 80, "encoded_capacity_ms": 400, "prebuffer_ms": 100, "next_prime_ms": 200, "max_playout_lateness_ms": 100}


def buffer_input(given: Mapping[str, Column]) -> tuple[dict[str, Column], Column]:
    """Every field with its default, and the error: fields that are given must be positive (two may be 0), and then the
    whole must fit together."""
    own = {k: F.coalesce(given[k], F.lit(v)) if k in given else F.lit(v) for k, v in BUFFER_DEFAULTS.items()}
    least = {"next_prime_ms": 0, "max_playout_lateness_ms": 0}
    bad = [own[k] < least.get(k, 1) for k in own]
    capacity = own["encoded_capacity_ms"]
    whole = [own["decode_batch_ms"] > 1000, capacity > 10_000, *[own[k] > capacity for k in ("prebuffer_ms", "next_prime_ms", "max_playout_lateness_ms")]]
    return own, invalid(*bad, *whole)


def source_input(timeout_ms, max_bytes, retries, backoff_ms) -> Column:
    """Of an HTTP source's settings; null keeps the default."""
    return invalid(timeout_ms <= 0, max_bytes <= 0, ~retries.between(0, 255), backoff_ms < 0, (retries > 0) & (backoff_ms == 0))


def track_input(kind, seekable, policy) -> tuple[Column, Column, Column]:
    """seekable, public_only and the error of an unknown kind or policy; live is never seekable."""
    bad = ~kind.isin("file", "url", "live") | kind.isNull() | (policy != "public-only")
    return F.when(kind == "live", F.lit(False)).otherwise(seekable), F.coalesce(policy == "public-only", F.lit(False)), invalid(bad, code=INVALID_SOURCE)


def ack_input(generation, outcome) -> Column:
    return invalid(generation < 0, ~outcome.isin(*OUTCOMES), outcome.isNull())


def transport_input(port_, rtcp_port, local_port, payload_type) -> Column:
    return F.coalesce(port(port_), port(rtcp_port), port(local_port, True), u8(payload_type))


def encryption_kind(mode: Column) -> Column:
    return F.when(F.coalesce(mode, F.lit("none")) == "none", "plain").otherwise("external")


# Small mappings.


def file_suffix(hint: Column) -> Column:
    return F.coalesce(F.concat(F.lit("."), hint), F.lit(""))


def address(ip: Column, port_: Column) -> Column:
    return F.concat_ws(":", ip, port_.cast("string"))


def rtcp_address(ip, rtp_port, rtcp_port, mux) -> Column:
    return address(ip, F.when(mux, rtp_port).otherwise(F.coalesce(rtcp_port, rtp_port)))


def flight_key(id_, url, headers, policy, *settings) -> Column:
    """Requests with equal keys share a transfer: the id with its length, a hash of what is asked, and the settings."""
    asked = F.sha1(F.to_json(F.struct(url.alias("u"), F.array_sort(F.map_entries(headers)).alias("h"), policy.alias("p"))))
    return F.concat_ws(":", F.octet_length(id_).cast("string"), id_, asked, *[x.cast("string") for x in settings])


def same_attempt(a: Column, b: Column) -> Column:
    return a == b


def made_progress(chunks, frames, packets, ended) -> Column:
    return (chunks > 0) | (frames > 0) | (packets > 0) | ended


def source_kind(kind: Column, hls: Column) -> Column:
    return F.when(hls, "hls").otherwise(kind)


def playlist_kind(end_list: Column) -> Column:
    """Neither can be sought."""
    return F.when(end_list, "url").otherwise("live")


def next_sequence(wanted: Column, first: Column) -> Column:
    """Where delivery goes on when the playlist has moved past what was wanted."""
    return F.greatest(wanted, first)


def content_range(value, start, length) -> Column:
    """Does a partial response's range say exactly what was asked; the total is a number or unknown."""
    parts = F.regexp_extract_all(value, F.lit(r"^\s*([^\s]+)\s+([0-9]+)-([0-9]+)/([0-9]+|\*)\s*$"), 0)
    group = lambda i: F.regexp_extract(value, r"^\s*(\S+)\s+([0-9]+)-([0-9]+)/([0-9]+|\*)\s*$", i)
    end = start + length - 1
    total = group(4)
    good = (F.lower(group(1)) == "bytes") & (group(2).try_cast("long") == start) & (group(3).try_cast("long") == end) & ((total == "*") | (total.try_cast("long") > end))
    return (F.size(parts) > 0) & F.coalesce(good, F.lit(False))


def ranged_response(status, value, declared, start, length, most) -> Column:
    """The error of a segment's response; without ``length`` a whole body was asked for."""
    ranged = length.isNotNull()
    return invalid(
        ranged & (status != 206), ranged & ~F.coalesce(content_range(value, start, length), F.lit(False)), declared > most, declared == 0, ranged & ((length > most) | (declared != length)),
        code=INVALID_SOURCE,
    )


def redirect(hops, bad_target) -> Column:
    """Of a public-only request: at most ten hops, each to a public address."""
    return invalid(hops >= 10, bad_target, code=INVALID_SOURCE)


def download(status, timeout, live, hls, declared, received, most, role) -> Column:
    """What becomes of a response: an error code, live, hls, or null for a whole artifact.  The status counts first, then
    what the headers reveal, then the sizes."""
    failed = timeout | ~status.between(200, 299)
    revealed = F.when(live, "live").when(hls, "hls")
    routed = F.when(role == "current", revealed).otherwise(F.lit(UNSUPPORTED))
    return F.when(failed, N.http_error_code(status, timeout)).when(live | hls, routed).when(any_of(declared > most, received > most, received == 0), INVALID_SOURCE)


def segment_kind(mapped_, box_error, moof_at, mdat_at, is_ts, elementary, first_box) -> tuple[Column, Column]:
    """The kind of a segment's bytes, and the error; by what the box walk, the transport test and the sniff have found."""
    fragment = F.when(box_error, "DECODE_ERROR").when(~F.coalesce(moof_at < mdat_at, F.lit(False)), INVALID_SOURCE)
    bare = first_box.isin("ftyp", "styp", "moof")
    kind = F.when(mapped_, F.when(fragment.isNull(), "fmp4")).when(is_ts, elementary).when(bare, F.lit(None)).otherwise(elementary)
    error = F.when(mapped_, fragment).when(is_ts, F.when(elementary.isNull(), UNSUPPORTED)).when(bare, UNSUPPORTED)
    return kind, error


def is_transport(b: Column, path: Column) -> Column:
    first = lambda at: F.hex(F.substring(b, at, 1)) == "47"
    return F.lower(path).endswith(".ts") | ((F.octet_length(b) >= 376) & first(1) & first(189))

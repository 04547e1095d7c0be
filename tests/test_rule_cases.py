"""Rules on literal cases; what each must give is written down here and not computed from the rules."""

import pytest
from pyspark.sql import functions as F

from tonearm.functions import checks as C
from tonearm.functions import numbers as N
from tonearm.functions import rules as R
from tonearm.operators import delivery as D
from tonearm.operators import playlists as P

BAD, CONFIG, UNSUPPORTED = "INVALID_SOURCE", "INVALID_CONFIG", "UNSUPPORTED"
NAN, INF = float("nan"), float("inf")
CASES = {}


def cases(name, given, expected, make, rows):
    CASES[name] = (given, [x.split() for x in expected.split(", ")], make, rows)


cases(
    "literal_hosts", "url string", "provider string, public_only string",
    lambda url: {"provider": R.url_policy(url), "public_only": R.url_policy(url, True)},
    [
        ("https://example.com/a", None, None), ("https://8.8.8.8/a", None, None), ("https://192.88.99.1/a", None, BAD), ("https://192.88.98.1/a", None, None),
        ("https://2130706433/", None, BAD), ("https://0x7f000001/", None, BAD), ("https://127.1/", None, BAD), ("https://0177.0.0.1/", None, BAD), ("https://134744072/", None, None),
        ("https://0x08.0x08.8.010/", None, None), ("https://1.2.3.4.5/", BAD, BAD), ("https://256.1.1.1/", BAD, BAD), ("https://1.2.3.08/", BAD, BAD), ("https://4294967296/", BAD, BAD),
        ("https://[fe80::1]/", None, BAD), ("https://[fc00::1]/x", None, BAD), ("https://[2001:db8::1]/", None, BAD), ("https://[::ffff:10.0.0.1]/", None, BAD),
        ("https://[::ffff:8.8.8.8]/", None, None), ("https://[2606:4700::1111]/", None, None), ("https://[2001:2:1::]/", None, BAD), ("https://[2001:2f::1]/", None, BAD),
        ("https://[2001:30::1]/", None, None), ("https://[2002::1]/", None, BAD), ("https://[::1]/", None, BAD), ("https://[1:2:3]/", BAD, BAD), ("https://[2606::1::2]/", BAD, BAD),
        ("https://[2606:4700:0:0:0:0:0:1]/", None, None), ("https://[2606:4700:0:0:0:0:1]/", BAD, BAD), ("https://user@example.com/", None, BAD), ("https://example.com:443/", None, None),
        ("https://example.com:444/", None, BAD), ("http://example.com/", None, BAD), ("ftp://example.com/", BAD, BAD), (None, BAD, BAD), ("example.com/a.mp3", BAD, BAD),
        ("https://224.0.0.1/", None, BAD), ("https://223.255.255.255/", None, None), ("https://100.63.0.1/", None, None), ("https://100.64.0.1/", None, BAD),
    ],
)

cases(
    "request_headers", "kind string, policy boolean, name string, value string", "error string",
    lambda kind, policy, name, value: {"error": R.headers(kind, F.when(name.isNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.create_map(name, value)), policy)},
    [
        ("url", False, None, None, None), ("file", False, None, None, None), ("url", True, None, None, None), ("url", False, "Authorization", "Bearer x", None),
        ("file", False, "Authorization", "x", BAD), ("url", True, "Accept", "*/*", BAD), ("url", False, "Range", "bytes=0-1", BAD), ("url", False, "keep-alive", "5", None),
        ("url", False, "TE", "trailers", BAD), ("url", False, "Host", "x", BAD), ("url", False, "Proxy-Authorization", "x", BAD), ("url", False, "bad name", "x", BAD),
        ("url", False, "", "x", BAD), ("url", False, "x-ok", "line\nbreak", BAD), ("url", False, "x-ok", "break at the end\n", BAD), ("url", False, "x-ok\n", "x", BAD), ("url", False, "x-ok", "tab\there", None), ("url", False, "x-ok", "café", BAD),
        ("live", False, "x-large", "y" * 16_378, BAD), ("live", False, "x-large", "y" * 16_377, None), ("url", False, "Content-Length", "1", BAD),
    ],
)

cases(
    "live_sniff", "server string, type string, icy string", "live boolean",
    lambda server, type, icy: {"live": R.live_response(F.map_filter(F.create_map(F.lit("Server"), server, F.lit("Content-Type"), type, F.lit("ICY-name"), icy), lambda k, v: v.isNotNull()))},  # noqa: A006
    [
        ("Icecast 2.4", "audio/mpeg", None, True), ("Icecast 2.4", "application/octet-stream", None, True), ("icecast-kh", "Application/OGG; x=1", None, True), ("Icecast", "text/html", None, False),
        ("nginx", "audio/mpeg", None, False), ("nginx", "text/html", "radio", True), (None, "audio/mpeg", None, False), ("Icecast", None, None, False),
    ],
)

cases(
    "http_errors", "status long, timeout boolean", "code string, retryable boolean",
    lambda status, timeout: {"code": N.http_error_code(status, timeout), "retryable": N.http_retryable(status, timeout)},
    [
        (None, True, "SOURCE_TIMEOUT", True), (401, False, "SOURCE_AUTH_EXPIRED", False), (403, False, "SOURCE_AUTH_EXPIRED", False), (404, False, BAD, False), (408, False, BAD, True), (429, False, BAD, True),
        (500, False, BAD, True), (503, False, BAD, True), (599, False, BAD, True), (600, False, BAD, False), (None, False, BAD, True), (410, False, BAD, False),
    ],
)

cases(
    "codec_classes", "codecs string, channels string", "class string, video boolean, channel_rank int",
    lambda codecs, channels: {"class": R.codec_class(codecs), "video": R.has_video(codecs), "channel_rank": R.channel_rank(channels)},
    [
        ("mp4a.40.2", "2", "verified", False, 0), ("mp4a.40.5", "2/-/x", "verified", False, 0), ("MP4A.40.29, avc1.64001f", "6", "verified", True, 1), ("mp4a.66", "1", "verified", False, 0),
        ("mp4a.6B", None, "verified", False, 1), ("opus", "2", "unknown", False, 0), ("flac", "x", "unknown", False, 1), ("dtsc", "2", "unsupported", False, 0), ("dts", "2", "unknown", False, 0),
        ("ec-3", "16/JOC", "unsupported", False, 1), ("ac-3.1,mp4a.40.2", "2", "verified", False, 0), ("ac-30", "2", "unknown", False, 0), ("mp4a.a6", " 2", "unsupported", False, 1),
        ("avc", "+2", "unknown", False, 0), ("avc1", "-1", "unknown", True, 1), ("hvc1.2.4", "0", "unknown", True, 0), ("vp09.00", "3", "unknown", True, 1), ("vp08", "", "unknown", False, 1), (None, "2", "unknown", False, 0),
        ("dvh1.05,ec-3", "2", "unsupported", True, 0), ("mp4v.20", "2", "unknown", False, 0), ("dtsl.x", "2", "unsupported", False, 0),
    ],
)

cases(
    "transport_config", "port long, rtcp_port long, mux boolean, mtu long, pt long, mode string, remote string, keepalive long", "error string, rtcp_addr string",
    lambda port, rtcp_port, mux, mtu, pt, mode, remote, keepalive: {
        "error": R.rtp_output(port, rtcp_port, mtu, pt, mode, mux, remote, F.lit("0.0.0.0"), keepalive), "rtcp_addr": C.rtcp_address(remote, port, rtcp_port, mux)
    },
    [
        (5004, None, True, 1200, 96, "none", "10.0.0.1", None, None, "10.0.0.1:5004"), (5004, 5005, False, 1200, 96, "none", "10.0.0.1", None, None, "10.0.0.1:5005"),
        (5004, None, False, 1200, 96, "none", "h", None, CONFIG, "h:5004"), (0, None, True, 1200, 96, "none", "h", None, CONFIG, "h:0"), (5004, 0, True, 1200, 96, "none", "h", None, CONFIG, "h:5004"),
        (5004, 5005, True, 63, 96, "none", "h", None, CONFIG, "h:5004"), (5004, 5005, True, 64, 127, "none", "h", None, None, "h:5004"), (5004, 5005, True, 65507, 128, "none", "h", None, CONFIG, "h:5004"),
        (5004, 5005, True, 65508, 0, "none", "h", None, CONFIG, "h:5004"), (5004, None, True, 1200, 96, "srtp", "h", None, UNSUPPORTED, "h:5004"), (5004, None, True, 1200, 96, " ", "h", None, CONFIG, "h:5004"),
        (5004, None, True, 1200, 96, "none", " ", None, CONFIG, " :5004"), (5004, None, True, 1200, 96, "none", "h", 999, CONFIG, "h:5004"), (5004, None, True, 1200, 96, "none", "h", 1000, None, "h:5004"),
        (5004, None, True, 1200, 96, "none", "h", 60_000, None, "h:5004"), (5004, None, True, 1200, 96, "none", "h", 60_001, CONFIG, "h:5004"),
    ],
)

cases(
    "resource_limits", "streams long, workers long, producers long, preloads long, http long, live long, live_bytes long, temp long", "error string",
    lambda streams, workers, producers, preloads, http, live, live_bytes, temp: {"error": R.limits(streams, producers, preloads, http, live, temp, workers, live_bytes)},
    [
        (1, 1, 2, 1, 2, 1, 1, 2 << 20, None), (0, 1, 2, 1, 2, 1, 1, 2 << 20, CONFIG), (1, 0, 2, 1, 2, 1, 1, 2 << 20, CONFIG), (1, 3, 2, 1, 2, 1, 1, 2 << 20, CONFIG), (1, 1, 2, 2, 2, 1, 1, 2 << 20, CONFIG),
        (1, 1, 2, 1, 1, 1, 1, 2 << 20, CONFIG), (1, 1, 2, 1, 2, 0, 1, 2 << 20, CONFIG), (1, 1, 2, 1, 2, 1, 0, 2 << 20, CONFIG), (1, 1, 2, 1, 2, 1, 1 << 32, 2 << 20, CONFIG), (1, 1, 2, 1, 2, 1, 1, (2 << 20) - 1, CONFIG),
    ],
)

cases(
    "runtime_config", "bitrate long, buffer long, budget long, http_bytes long, temp long, rtcp long, start long", "error string",
    lambda bitrate, buffer, budget, http_bytes, temp, rtcp, start: {"error": C.runtime(bitrate, buffer, budget, http_bytes, temp, rtcp, start)},
    [
        (128_000, 1, 1, 1 << 20, 4 << 20, 1, 1, None), (499, 1, 1, 1 << 20, 4 << 20, 1, 1, CONFIG), (512_000, 1, 1, 1 << 20, 4 << 20, 1, 900_000, None), (512_001, 1, 1, 1 << 20, 4 << 20, 1, 1, CONFIG),
        (500, 2, 1, 1 << 20, 4 << 20, 1, 1, CONFIG), (500, 1, 1, (1 << 20) + 1, 4 << 20, 1, 1, CONFIG), (500, 1, 1, (1 << 20) + 1, 8 << 20, 1, 1, None), (500, 1, 1, 1, 4 << 20, 0, 1, CONFIG),
        (500, 1, 1, 1, 4 << 20, 1, 0, CONFIG), (500, 1, 1, 1, 4 << 20, 1, 900_001, CONFIG), (500, 1, 1, 1, (4 << 20) - 1, 1, 1, CONFIG),
    ],
)

cases(
    "gain_config", "track double, album double, target double, min_db double, curve double, extra double", "gain string, volume string",
    lambda track, album, target, min_db, curve, extra: {"gain": C.replay_gain(track, album, target), "volume": C.volume(min_db, curve, extra)},
    [
        (0.9, None, -1.0, -60.0, 0.5, 0.0, None, None), (0.0, None, -1.0, 0.0, 0.5, 0.0, CONFIG, CONFIG), (NAN, None, -1.0, NAN, 0.5, 0.0, CONFIG, CONFIG), (None, INF, 0.0, -INF, 0.5, 0.0, CONFIG, CONFIG),
        (None, None, 0.1, -60.0, 0.0, 0.0, CONFIG, CONFIG), (None, None, NAN, -60.0, INF, 0.0, CONFIG, CONFIG), (2.0, 1.5, 0.0, -0.1, 2.0, 12.0, None, None), (1.0, -0.1, 0.0, -60.0, 1.0, 12.5, CONFIG, CONFIG),
        (1.0, 1.0, -INF, -60.0, 1.0, -60.0, CONFIG, None), (1.0, 1.0, -3.0, -60.0, 1.0, -60.1, None, CONFIG),
    ],
)

cases(
    "pipeline_config", "generation long, rate long, channels long, samples long, batch long, chunk_rate long, chunk_channels long", "config string, chunk string",
    lambda generation, rate, channels, samples, batch, chunk_rate, chunk_channels: {
        "config": C.pipeline(generation, rate, channels, samples, batch), "chunk": C.chunk(chunk_rate, chunk_channels, rate, channels)
    },
    [
        (1, 48_000, 2, 960, 80, 48_000, 2, None, None), (0, 48_000, 2, 960, 80, 48_000, 1, CONFIG, "DECODE_ERROR"), (1, 0, 2, 960, 80, 44_100, 2, CONFIG, "DECODE_ERROR"), (1, 48_000, 0, 960, 80, 48_000, 0, CONFIG, None),
        (1, 48_000, 2, 0, 80, 48_000, 2, CONFIG, None), (1, 48_000, 2, 960, 0, 48_000, 2, CONFIG, None), (1, 48_000, 2, 960, 19, 48_000, 2, CONFIG, None), (1, 48_000, 2, 960, 20, 48_000, 2, None, None),
        (1, 48_000, 2, 47, 20, 48_000, 2, CONFIG, None), (7, 48_000, 2, 48, 1, 48_000, 2, None, None),
    ],
)

cases(
    "source_config", "timeout long, most long, retries long, backoff long, buffered long", "http string, live string, input string",
    lambda timeout, most, retries, backoff, buffered: {
        "http": C.http_source(timeout, most, retries, backoff), "live": C.live_source(timeout, F.lit(1), buffered, retries, backoff), "input": C.source_input(timeout, most, retries, backoff)
    },
    [
        (1, 1, 0, 0, 1, None, None, None), (0, 1, 0, 0, 1, CONFIG, CONFIG, CONFIG), (1, 0, 0, 0, 1, CONFIG, None, CONFIG), (1, 1, 1, 0, 1, CONFIG, CONFIG, CONFIG), (1, 1, 1, 1, 1, None, None, None),
        (1, 1, 255, 1, 0, None, CONFIG, None), (1, 1, 256, 1, 1, None, None, CONFIG), (1, (1 << 20) * ((1 << 32) - 1), 0, 0, 1, None, None, None), (1, (1 << 20) * ((1 << 32) - 1) + 1, 0, 0, 1, CONFIG, None, None),
        (1, 1, 0, -1, 1, None, None, CONFIG),
    ],
)

cases(
    "resampler_config", "rate long, channels long, frames long, ratio double, sinc long, over long", "error string",
    lambda rate, channels, frames, ratio, sinc, over: {"error": C.resampler(rate, channels, frames, ratio, sinc, over)},
    [
        (48_000, 2, 1024, 1.1, 128, 256, None), (0, 2, 1024, 1.1, 128, 256, CONFIG), (48_000, 0, 1024, 1.1, 128, 256, CONFIG), (48_000, 2, 0, 1.1, 128, 256, CONFIG), (48_000, 2, 1, 1.0, 128, 256, CONFIG),
        (48_000, 2, 1, 1.01, 0, 256, CONFIG), (48_000, 2, 1, 1.01, 1, 0, CONFIG), (8000, 1, 1, 1.01, 1, 1, None),
    ],
)

cases(
    "input_conversion", "hint string, port long, local long, byte long, real double, id string", "own_hint string, hint_error string, ports string, u8 string, f32 string, stream string",
    lambda hint, port, local, byte, real, id: {  # noqa: A006
        "own_hint": C.format_hint(hint)[0], "hint_error": C.format_hint(hint)[1], "ports": F.coalesce(C.port(port), C.port(local, True)), "u8": C.u8(byte), "f32": C.f32(real), "stream": C.stream_id(id)
    },
    [
        (" MP3 ", 1, 0, 0, 0.0, "a", "mp3", None, None, None, None, None), ("", 0, 0, 255, 1e39, "", None, BAD, CONFIG, None, CONFIG, CONFIG), ("a/b", 65_535, 65_535, 256, NAN, "  ", None, BAD, None, CONFIG, CONFIG, CONFIG),
        ("x" * 16, 65_536, 0, -1, INF, "x" * 512, "x" * 16, None, CONFIG, CONFIG, CONFIG, None), ("x" * 17, 5, -1, 7, -3.4e38, "x" * 513, None, BAD, CONFIG, None, None, CONFIG), ("mp3\n", 1, 0, 0, 0.0, "a", None, BAD, None, None, None, None), (None, 5, 65_536, 7, -1e300, "é" * 257, None, None, CONFIG, None, CONFIG, CONFIG),
    ],
)

cases(
    "buffer_input", "batch long, capacity long, prebuffer long, prime long, late long", "error string, own_capacity long, own_prime long",
    lambda batch, capacity, prebuffer, prime, late: (
        lambda own, error: {"error": error, "own_capacity": own["encoded_capacity_ms"], "own_prime": own["next_prime_ms"]}
    )(*C.buffer_input({"decode_batch_ms": batch, "encoded_capacity_ms": capacity, "prebuffer_ms": prebuffer, "next_prime_ms": prime, "max_playout_lateness_ms": late})),
    [
        (None, None, None, None, None, None, 400, 200), (0, None, None, None, None, CONFIG, 400, 200), (1001, None, None, None, None, CONFIG, 400, 200), (1000, None, None, None, None, None, 400, 200),
        (None, 199, None, None, None, CONFIG, 199, 200), (None, 200, None, None, None, None, 200, 200), (None, None, 401, None, None, CONFIG, 400, 200), (None, None, None, 0, 0, None, 400, 0),
        (None, None, None, -1, None, CONFIG, 400, -1), (None, 10_001, None, None, None, CONFIG, 10_001, 200), (None, 10_000, None, None, 10_000, None, 10_000, 200), (None, None, None, None, 401, CONFIG, 400, 200),
    ],
)

cases(
    "host_input", "kind string, seekable boolean, policy string, generation long, outcome string, mode string", "own_seekable boolean, public_only boolean, track string, ack string, protection string",
    lambda kind, seekable, policy, generation, outcome, mode: {
        **dict(zip(("own_seekable", "public_only", "track"), C.track_input(kind, seekable, policy), strict=True)), "ack": C.ack_input(generation, outcome), "protection": C.encryption_kind(mode)
    },
    [
        ("file", True, None, 0, "sent", None, True, False, None, None, "plain"), ("live", True, "public-only", 1, "late", "none", False, True, None, None, "plain"), ("url", None, "provider", -1, "sent", "srtp", None, False, BAD, CONFIG, "external"),
        ("URL", False, None, 3, "Sent", "", False, False, BAD, CONFIG, "external"), (None, True, None, 2, None, "none", True, False, BAD, CONFIG, "plain"), ("live", None, None, 9, "outputUnavailable", "x", False, False, None, None, "external"),
        ("url", True, "public-only", 9, "cancelled", None, True, True, None, None, "plain"),
    ],
)

cases(
    "error_codes", "name string, stage string", "code string, stage_code string",
    lambda name, stage: {"code": C.error_code(name), "stage_code": C.codec_error(stage)},
    [
        ("StreamNotFound", "seek", "STREAM_NOT_FOUND", "NOT_SEEKABLE"), ("StreamAlreadyExists", "io", "STREAM_ALREADY_EXISTS", "DECODE_ERROR"), ("InvalidConfig", "decode", "INVALID_CONFIG", "DECODE_ERROR"),
        ("InvalidSource", "limit", "INVALID_SOURCE", "DECODE_ERROR"), ("DetectedLiveSource", "reset", "UNSUPPORTED", "DECODE_ERROR"), ("DetectedHlsSource", "resampler", "UNSUPPORTED", "RESAMPLE_ERROR"),
        ("SourceTimeout", "io", "SOURCE_TIMEOUT", "DECODE_ERROR"), ("SourceAuthExpired", "io", "SOURCE_AUTH_EXPIRED", "DECODE_ERROR"), ("Unsupported", "io", "UNSUPPORTED", "DECODE_ERROR"), ("Busy", "io", "BUSY", "DECODE_ERROR"),
        ("StreamClosed", "io", "STREAM_CLOSED", "DECODE_ERROR"), ("NotSeekable", "io", "NOT_SEEKABLE", "DECODE_ERROR"), ("DecodeError", "io", "DECODE_ERROR", "DECODE_ERROR"), ("ResampleError", "io", "RESAMPLE_ERROR", "DECODE_ERROR"),
        ("EncodeError", "io", "ENCODE_ERROR", "DECODE_ERROR"), ("RtpOutputError", "io", "OUTPUT_ERROR", "DECODE_ERROR"), ("ExternalPullError", "io", "OUTPUT_ERROR", "DECODE_ERROR"), ("Internal", "io", "INTERNAL", "DECODE_ERROR"), ("Other", "io", None, "DECODE_ERROR"),
    ],
)

cases(
    "ranged_fetch", "status long, value string, declared long, start long, length long, most long", "error string",
    lambda status, value, declared, start, length, most: {"error": C.ranged_response(status, value, declared, start, length, most)},
    [
        (206, "bytes 10-19/100", 10, 10, 10, 100, None), (206, "Bytes  10-19/*", None, 10, 10, 100, None), (200, "bytes 10-19/100", 10, 10, 10, 100, BAD), (206, None, 10, 10, 10, 100, BAD), (206, "bytes 10-20/100", 10, 10, 10, 100, BAD),
        (206, "bytes 10-19/19", 10, 10, 10, 100, BAD), (206, "bytes 10-19/20", 10, 10, 10, 100, None), (206, "items 10-19/100", 10, 10, 10, 100, BAD), (206, "bytes 10-19/100 x", 10, 10, 10, 100, BAD),
        (206, "bytes 10-19", 10, 10, 10, 100, BAD), (206, "bytes 10-19/100", 9, 10, 10, 100, BAD), (206, "bytes 10-19/100", 10, 10, 10, 9, BAD), (200, None, 5, None, None, 5, None), (200, None, 6, None, None, 5, BAD), (200, None, 0, None, None, 5, BAD), (200, None, None, None, None, 5, None),
    ],
)

cases(
    "download_outcome", "status long, timeout boolean, live boolean, hls boolean, declared long, received long, role string, hops long, url string", "outcome string, redirect string",
    lambda status, timeout, live, hls, declared, received, role, hops, url: {
        "outcome": C.download(status, timeout, live, hls, declared, received, F.lit(100), role), "redirect": C.redirect(hops, R.url_policy(url, True).isNotNull())
    },
    [
        (200, False, False, False, 100, 100, "current", 0, "https://a.example/", None, None), (200, False, False, False, 101, 5, "current", 9, "https://a.example/", BAD, None), (200, False, False, False, None, 101, "current", 10, "https://a.example/", BAD, BAD),
        (200, False, False, False, None, 0, "next", 1, "http://a.example/", BAD, BAD), (200, False, True, False, 500, 5, "current", 1, "https://10.0.0.1/", "live", BAD), (200, False, False, True, 500, 5, "current", 1, "https://a.example:8443/", "hls", BAD),
        (200, False, True, False, 5, 5, "next", 1, "https://a.example/", UNSUPPORTED, None), (403, False, True, False, 5, 5, "current", 1, "https://a.example/", "SOURCE_AUTH_EXPIRED", None), (503, False, False, True, 5, 5, "current", 1, "https://a.example/", BAD, None),
        (None, True, False, False, None, None, "current", 1, "https://[::1]/", "SOURCE_TIMEOUT", BAD), (204, False, False, False, 0, 0, "current", 1, "https://a.example/", BAD, None),
    ],
)

cases(
    "segment_normalization", "mapped boolean, broken boolean, moof long, mdat long, ts boolean, sniffed string, box string", "kind string, error string",
    lambda mapped, broken, moof, mdat, ts, sniffed, box: dict(zip(("kind", "error"), C.segment_kind(mapped, broken, moof, mdat, ts, sniffed, box), strict=True)),
    [
        (True, False, 0, 9, False, None, "moof", "fmp4", None), (True, False, 9, 0, False, None, "mdat", None, BAD), (True, False, None, 0, False, None, "mdat", None, BAD), (True, True, 0, 9, False, None, "moof", None, "DECODE_ERROR"),
        (False, False, None, None, True, "aac", "G@", "aac", None), (False, False, None, None, True, None, "G@", None, UNSUPPORTED), (False, False, None, None, False, "mpeg", "x", "mpeg", None), (False, False, 0, 9, False, None, "moof", None, UNSUPPORTED),
        (False, False, None, None, False, None, "styp", None, UNSUPPORTED), (False, False, None, None, False, None, "x", None, None),
    ],
)

cases(
    "labels_and_identity", "kind string, hls boolean, ended boolean, attempt string, other string, chunks long, frames long, packets long, over boolean, hint string, wanted long, first long",
    "source string, playlist string, same boolean, progress boolean, suffix string, sequence long",
    lambda kind, hls, ended, attempt, other, chunks, frames, packets, over, hint, wanted, first: {
        "source": C.source_kind(kind, hls), "playlist": C.playlist_kind(ended), "same": C.same_attempt(attempt, other), "progress": C.made_progress(chunks, frames, packets, over), "suffix": C.file_suffix(hint),
        "sequence": C.next_sequence(wanted, first),
    },
    [
        ("file", False, True, "a", "a", 0, 0, 0, False, "mp3", 5, 3, "file", "url", True, False, ".mp3", 5), ("url", True, False, "a", "b", 1, 0, 0, False, None, 5, 9, "hls", "live", False, True, "", 9),
        ("live", True, True, "a", "A", 0, 1, 0, False, "ogg", 0, 0, "hls", "url", False, True, ".ogg", 0), ("live", False, False, "", "", 0, 0, 1, False, "x", 7, 7, "live", "live", True, True, ".x", 7), ("url", False, True, "a", "a", 0, 0, 0, True, "x", 1, 2, "url", "url", True, True, ".x", 2),
    ],
)

cases(
    "gap_marks", "tag string", "gap boolean", lambda tag: {"gap": R.is_gap(F.split(tag, ","))},
    [("X-GAP", True), ("x-gap", True), ("X-GAPS", False), ("X-A,X-Gap", True), ("X-A", False), (None, False)],
)

cases(
    "response_kinds", "path string, type string, hint string, extension string, head string", "hls boolean, progressive string, elementary string",
    lambda path, type, hint, extension, head: {"hls": R.hls_response(path, type), "progressive": R.progressive_mode(hint, extension), "elementary": R.elementary_kind(F.unhex(head))},  # noqa: A006
    [
        ("/a/INDEX.M3U8", "text/plain", "mp3", None, "FFF1", True, "immediate", "aac"), ("/a/b", "Application/X-mpegURL; charset=utf-8", None, "m4a", "FFF9", True, "probe", "aac"), ("/a.m3u8/b", "text/html", "MP4", "mp3", "FFFB", False, "probe", "mpeg"),
        ("/a", "audio/mpegurl", "ogg", "txt", "FFE0", True, "immediate", "mpeg"), ("/a", "audio/x-mpegurl", "txt", "flac", "FFDF", True, "immediate", None), ("/a", "application/mpegurl", "txt", None, "00F1", True, "none", None),
        ("/a", "application/vnd.apple.mpegurl", None, None, "FF", True, "none", None), ("/a", None, "opus", "mp4", "FFF6", False, "probe", "mpeg"), ("/a.m3u", "audio/mpeg", "wave", None, "FFF0", False, "immediate", "aac"),
    ],
)

cases(
    "packet_rules", "payload string, mtu long, output string, code string, message string, micros long, ids long", "packet string, most long, text string, samples long, batch string",
    lambda payload, mtu, output, code, message, micros, ids: {
        "packet": F.when(mtu == 16, F.hex(N.rtp_packet(F.unhex(payload), 16, marker=F.lit(True), payload_type=96, sequence=F.lit(65_537), timestamp=F.lit(4_294_967_297), ssrc=F.lit(7)))), "most": N.payload_limit(output, mtu),
        "text": N.error_text(code, message), "samples": N.samples_of_micros(micros), "batch": C.status_batch(F.array_repeat(F.lit("s"), ids.cast("int"))),
    },
    [
        ("F8FFFE", 16, "rtp", "BUSY", "wait", 1_000_000, 1, "80E000010000000100000007F8FFFE", 4, "BUSY: wait", 48_000, None), ("", 16, "pull", "INTERNAL", "", 20, 4096, None, 1500, "INTERNAL: ", 0, None),
        ("0102030405", 16, "rtp", "X", "y: z", 20_833, 4097, None, 4, "X: y: z", 999, CONFIG), ("01020304", 16, "rtp", "X", "y", 20_834, 0, "80E00001000000010000000701020304", 4, "X: y", 1000, None), ("01", 1200, "rtp", "X", "y", 0, 9, None, 1188, "X: y", 0, None),
    ],
)

cases(
    "url_joins", "base string, ref string", "joined string", lambda base, ref: {"joined": P.url_join(base, ref)},
    [
        ("https://a.example/x/y.m3u8?t=1", "z.ts", "https://a.example/x/z.ts"), ("https://a.example/x/y", "/r/z.ts", "https://a.example/r/z.ts"), ("https://a.example/x/y", "//b.example/z", "https://b.example/z"),
        ("https://a.example/x/y", "http://c.example/z?q", "http://c.example/z?q"), ("https://a.example", "z.ts", "https://a.example/z.ts"), ("https://a.example/x/y?t=1", "?t=2", "https://a.example/x/y?t=2"),
        ("https://a.example/x/y/w", "../z.ts", "https://a.example/x/z.ts"), ("https://a.example/x/y/w", "./z.ts", "https://a.example/x/y/z.ts"), ("https://a.example/x", "../../z.ts", "https://a.example/z.ts"),
        ("https://a.example/x/y", "b/./c/../z.ts?u=/../v", "https://a.example/x/b/z.ts?u=/../v"), ("https://a.example/x/y", "..", "https://a.example/"), ("https://a.example/x/y/w", "z/.", "https://a.example/x/y/z/"),
    ],
)

cases(
    "attempt_errors", "decoder string, decoder_at long, source string, source_at long", "error string",
    lambda decoder, decoder_at, source, source_at: {"error": D.attempt_error(decoder, decoder_at, source, source_at)},
    [
        (None, 100, None, 50, None), ("DECODE_ERROR", 100, None, 50, "DECODE_ERROR"), ("DECODE_ERROR", 100, "SOURCE_TIMEOUT", 350, "SOURCE_TIMEOUT"), ("DECODE_ERROR", 100, "SOURCE_TIMEOUT", 351, "DECODE_ERROR"),
        ("DECODE_ERROR", 100, "STREAM_CLOSED", 200, "DECODE_ERROR"), (None, 100, "STREAM_CLOSED", 200, None), (None, 100, "STREAM_CLOSED", 99, "STREAM_CLOSED"), (None, 100, "INVALID_SOURCE", 99, "INVALID_SOURCE"), ("DECODE_ERROR", 100, None, None, "DECODE_ERROR"),
        ("DECODE_ERROR", 100, "SOURCE_AUTH_EXPIRED", 100, "SOURCE_AUTH_EXPIRED"), (None, 100, "INVALID_SOURCE", 250, "INVALID_SOURCE"),
    ],
)

cases(
    "reader_rules", "offset long, wanted long, available long, state string, delivered long, attempt long, retryable boolean, cached boolean, flight boolean, cached_after boolean",
    "outcome string, n long, again boolean, path string",
    lambda offset, wanted, available, state, delivered, attempt, retryable, cached, flight, cached_after: {
        **dict(zip(("outcome", "n"), D.spool_read(offset, wanted, available, state), strict=True)), "again": D.live_retry(delivered, attempt, F.lit(2), retryable), "path": D.cache_path(cached, flight, cached_after)
    },
    [
        (0, 10, 5, "open", 0, 0, True, True, True, True, "read", 5, True, "hit"), (5, 10, 5, "open", 1, 0, True, False, True, True, "wait", 0, False, "follow"), (5, 10, 5, "complete", 0, 2, True, False, False, True, "eof", 0, False, "late_hit"),
        (5, 10, 5, "failed", 0, 1, False, False, False, False, "error", 0, False, "lead"), (4, 10, 5, "failed", 0, 1, True, False, False, False, "read", 1, True, "lead"), (0, 3, 5, "complete", 0, 1, True, True, False, False, "read", 3, True, "hit"),
    ],
)

cases(
    "aes_segments", "method string, format string, versions string, iv string, sequence long, init boolean", "iv_hex string, error string",
    lambda method, format, versions, iv, sequence, init: dict(zip(("iv_hex", "error"), R.segment_iv(method, format, versions, iv, sequence, init), strict=True)),  # noqa: A006
    [
        ("AES-128", None, None, "0x1F", 7, False, "0000000000000000000000000000001F", None), ("AES-128", None, None, None, 258, False, "00000000000000000000000000000102", None), ("AES-128", None, None, None, 258, True, None, BAD),
        ("AES-128", "identity", "1", "0Xabc", 7, True, "00000000000000000000000000000ABC", None), ("AES-128", "com.example", None, "0x1", 7, False, None, UNSUPPORTED), ("AES-128", "IDENTITY", "1/2", "0x1", 7, False, None, UNSUPPORTED),
        ("SAMPLE-AES", None, None, "0x1", 7, False, None, UNSUPPORTED), ("NONE", None, None, None, 7, True, None, None), (None, None, None, None, 7, True, None, None), ("AES-128", None, None, "1F", 7, False, None, BAD), ("AES-128", None, None, "0x", 7, False, None, BAD),
        ("AES-128", None, "1", "0x" + "9" * 32, 7, False, "9" * 32, None), ("AES-128", None, None, "0x" + "9" * 33, 7, False, None, BAD), ("AES-128", None, " 1 / 1", "0xG", 7, False, None, BAD), ("AES-128", None, None, "0x1\n", 7, False, None, BAD),
    ],
)


@pytest.mark.parametrize("name", list(CASES))
def test_cases(spark, name):
    given, outputs, make, rows = CASES[name]
    inputs = [x.split()[0] for x in given.split(", ")]
    known = spark.createDataFrame([(k, *row[: len(inputs)]) for k, row in enumerate(rows)], f"_k long, {given}")
    made = make(**{n: F.col(n) for n in inputs})
    got = known.select("_k", *[made[n].cast(kind).alias(n) for n, kind in outputs]).orderBy("_k").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(row[len(inputs) :]) for row in rows]


def test_packet_rules_make_no_lists(spark, tmp_path):
    """A batch is told by its number of ids: two thousand million of them are no list."""
    import datetime

    from tonearm.plans.column_rules import QUERIES

    rows = [(i, user, "view", 1.5, "{}", datetime.datetime(2024, 1, 1)) for i, user in ((1, 7), (2, 4096), (3, 4097), (4, 2_000_000_000), (50, 48), (100, 49), (150, 900_000_000))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["batch"] for r in QUERIES["packet_rules"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: None, 3: CONFIG, 4: CONFIG, 50: None, 100: CONFIG, 150: CONFIG}

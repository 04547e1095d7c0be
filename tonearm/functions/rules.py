"""Validation and classification rules, as Column builders.

A validator gives null for a good row, or a stable error code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import bound

INVALID_SOURCE, INVALID_CONFIG, UNSUPPORTED = "INVALID_SOURCE", "INVALID_CONFIG", "UNSUPPORTED"
#: A pattern ends with \z: $ would let a line break at the end pass.
HINT = r"^[A-Za-z0-9]{1,16}\z"
MIN_MTU, MAX_DATAGRAM, MIN_KEEPALIVE_MS, MAX_KEEPALIVE_MS = 64, 65_507, 1000, 60_000
#: Header names a source may not set.
FORBIDDEN_HEADERS = ("connection", "content-length", "host", "proxy-authenticate", "proxy-authorization", "range", "te", "trailer", "transfer-encoding", "upgrade")
HEADER_NAME, HEADER_VALUE = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+\z", r"^[\t\x20-\x7E]*\z"
#: Playlist content types.
HLS_TYPES = ("application/vnd.apple.mpegurl", "application/x-mpegurl", "audio/mpegurl", "audio/x-mpegurl", "application/mpegurl")
#: Formats that can start before they are whole.
STREAMABLE = ("mp3", "aac", "flac", "ogg", "oga", "opus", "wav", "wave")
MP4 = ("mp4", "m4a")
#: Codec families of variants.
VERIFIED_CODECS = ("mp3", "mp4a.40.2", "mp4a.40.5", "mp4a.40.29", "mp4a.40.34", "mp4a.66", "mp4a.67", "mp4a.68", "mp4a.69", "mp4a.6b")
UNSUPPORTED_CODECS = ("mp4a.a5", "mp4a.a6", "mp4a.a9", "mp4a.aa", "mp4a.ab", "mp4a.ac")
UNSUPPORTED_FAMILIES = ("ac-3", "ec-3", "ac-4", "dtsc", "dtse", "dtsh", "dtsl")
VIDEO_FAMILIES = ("avc1", "avc3", "hvc1", "hev1", "dvh1", "dvhe", "vp09", "av01")
#: IPv4 blocks that aren't public, as (first address, prefix length).
NON_PUBLIC_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def v4_number(dotted: str) -> int:
    return reduce(lambda a, b: a * 256 + int(b), dotted.split("."), 0)


def ipv4(text: Column) -> Column:
    """A dotted address as a long; null if it is none."""
    parts = F.split(text, r"\.")
    good = text.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    return F.when(good, reduce(lambda a, i: a * 256 + F.try_element_at(parts, F.lit(i)).try_cast("long"), range(1, 5), F.lit(0)))


def public_ipv4(n: Column) -> Column:
    blocks = [n.between(v4_number(a), v4_number(a) + (1 << (32 - bits)) - 1) for a, bits in NON_PUBLIC_V4]
    return ~any_of(*blocks)


def public_ipv6(groups: Column) -> Column:
    """Of eight 16-bit groups: global unicast without the documentation, benchmark, ORCHID and 6to4 blocks.

    A mapped IPv4 address is judged as that."""
    g = lambda i: F.try_element_at(groups, F.lit(i + 1))
    mapped = F.forall(F.slice(groups, 1, 5), lambda x: x == 0) & (g(5) == 0xFFFF)
    special = any_of(
        (g(0) == 0x2001) & (g(1) == 0xDB8), (g(0) == 0x2001) & (g(1) == 2), (g(0) == 0x2001) & g(1).between(0x20, 0x2F), g(0) == 0x2002
    )
    return F.when(mapped, public_ipv4(g(6).cast("long") * 65536 + g(7))).otherwise(g(0).between(0x2000, 0x3FFF) & ~special)


def url_part(url: Column, part: str) -> Column:
    """protocol, user, host, port or path of an address; empty where there is none."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?([^?#]*)"
    return F.regexp_extract(url, pattern, {"protocol": 1, "user": 2, "host": 3, "port": 4, "path": 5}[part])


def host_ipv4(host: Column) -> Column:
    """A host whose last label is a number, as an address parser takes it: up to four parts, each decimal, octal (0...) or
    hexadecimal (0x...), the last filling what is left.  Null for other hosts, -1 for numbers that are no address."""
    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    number = lambda p: (
        F.when(p.rlike("^0[xX]$"), F.lit(0)).when(p.rlike("^0[xX][0-9A-Fa-f]{1,12}$"), F.conv(F.substring(p, 3, 20), 16, 10).try_cast("long"))
        .when(p.rlike("^0[0-7]{1,20}$"), F.conv(p, 8, 10).try_cast("long")).when(p.rlike("^(0|[1-9][0-9]{0,14})$"), p.try_cast("long"))
    )

    def value(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        first = lambda: F.slice(parts, 1, n - 1)
        good = (n <= 4) & F.forall(first(), lambda x: x.between(0, 255)) & (last < F.pow(F.lit(256.0), F.lit(5) - n))
        sum_ = F.aggregate(F.transform(first(), lambda x, i: x * F.pow(F.lit(256.0), F.lit(3) - i).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y) + last
        return F.when(F.coalesce(good, F.lit(False)), sum_).otherwise(F.lit(-1).cast("long"))

    return F.when(host.rlike(r"(^|\.)([0-9]+|0[xX][0-9A-Fa-f]*)\.?$"), bound(F.transform(labels, number), value))


def ipv6(text: Column) -> Column:
    """The eight 16-bit groups of an address in any spelling; null if it is none."""
    as_hex = lambda v4: F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), F.lower(F.hex(F.shiftright(v4, 16))), F.lit(":"), F.lower(F.hex(v4.bitwiseAND(65_535))))
    whole = F.when(F.contains(text, F.lit(".")), bound(ipv4(F.regexp_extract(text, r":([0-9.]+)$", 1)), as_hex)).otherwise(text)
    part = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def full(halves: Column) -> Column:
        """Of the groups on either side of a gap, if there is one."""
        n = F.size(F.get(halves, 0)) + F.coalesce(F.size(F.get(halves, 1)), F.lit(0))
        short = F.size(halves) == 2
        room = F.when(short & (n <= 7), F.lit(8) - n).when((F.size(halves) == 1) & (n == 8), 0)
        return F.when(room.isNotNull(), F.concat(F.get(halves, 0), F.array_repeat(F.lit("0"), room), F.coalesce(F.get(halves, 1), F.array().cast("array<string>"))))

    groups = bound(F.transform(F.split(whole, "::", -1), part), full)
    numbers = lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")))
    return bound(groups, numbers)


def host_kind(host: Column) -> Column:
    """public, private or broken: of a literal address, or of what looks like one; other names are public."""
    v4 = lambda n: F.when(n < 0, "broken").when(n.isNull() | public_ipv4(n), "public").otherwise("private")
    v6 = lambda g: F.when(g.isNull(), "broken").when(public_ipv6(g), "public").otherwise("private")
    return F.when(host.startswith("["), bound(ipv6(F.regexp_replace(host, r"^\[|\]$", "")), v6)).otherwise(bound(host_ipv4(host), v4))


def url_policy(url: Column, public_only: bool = False) -> Column:
    scheme, kind = F.lower(url_part(url, "protocol")), bound(F.lower(url_part(url, "host")), lambda h: F.when(h == "", "broken").otherwise(host_kind(h)))
    bad = [url.isNull(), ~scheme.isin("http", "https"), kind.isin(["broken", "private"] if public_only else ["broken"])]
    if public_only:
        port = url_part(url, "port")
        bad += [scheme != "https", url_part(url, "user").rlike("[^:]"), (port != "") & (port.try_cast("int") != 443)]
    return F.when(any_of(*bad), INVALID_SOURCE)


def url_extension(url: Column, hint: Column | None = None) -> Column:
    """The last path piece's extension, 1 to 16 alphanumerics, lowered; a good hint overrides it."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    own = F.lower(F.regexp_extract(F.regexp_extract(bare, r"([^/]*)$", 1), r"\.([A-Za-z0-9]{1,16})$", 1))
    own = F.nullif(own, F.lit(""))
    return own if hint is None else F.when(hint.rlike(HINT), F.lower(hint)).otherwise(own)


def track(kind: Column, id_: Column, attempt: Column, url: Column, path: Column, hint: Column) -> Column:
    blank = lambda c: c.isNull() | (F.trim(c) == "") | (F.octet_length(c) > 512)
    place = F.when(kind == "file", path).otherwise(url)
    return F.when(
        any_of(
            blank(id_), blank(attempt), ~kind.isin("file", "url", "live"), place.isNull(), place == "", F.octet_length(place) > 16 << 10, ~hint.rlike(HINT),
            (kind != "file") & url_policy(url).isNotNull(),
        ), INVALID_SOURCE,
    )


def headers(kind: Column, h: Column, public_only: Column) -> Column:
    size = F.aggregate(F.map_entries(h), F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    banned = F.exists(F.map_keys(h), lambda k: F.lower(k).isin(*FORBIDDEN_HEADERS))
    odd = F.exists(F.map_entries(h), lambda e: ~e["key"].rlike(HEADER_NAME) | ~e["value"].rlike(HEADER_VALUE))
    some = F.size(h) > 0
    return F.when(any_of(some & ((kind == "file") | public_only), F.size(h) > 16, size > 16 << 10, banned, odd), INVALID_SOURCE)


def is_hls(url: Column, hint: Column) -> Column:
    return any_of(F.lower(hint) == "m3u8", F.lower(hint) == "m3u", F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".m3u8"))


def hls_response(path: Column, content_type: Column) -> Column:
    return any_of(F.lower(path).endswith(".m3u8"), F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))).isin(*HLS_TYPES))


def live_response(h: Column) -> Column:
    """Any icy- header; or an icecast server with audio."""
    names = F.transform(F.map_keys(h), F.lower)
    value = lambda name: F.lower(F.aggregate(F.map_entries(h), F.lit(""), lambda a, e: F.when(F.lower(e["key"]) == name, e["value"]).otherwise(a)))
    kind = value("content-type")
    return any_of(F.exists(names, lambda k: k.startswith("icy-")), value("server").contains("icecast") & (kind.startswith("audio/") | kind.startswith("application/ogg") | kind.startswith("application/octet-stream")))


def seekable(kind: Column, hls: Column, asked: Column) -> Column:
    return ~hls & (kind != "live") & F.coalesce(asked, F.lit(True))


def progressive_mode(hint: Column, extension: Column) -> Column:
    either = lambda names: any_of(F.lower(hint).isin(*names), F.lower(extension).isin(*names))
    return F.when(either(MP4), "probe").when(either(STREAMABLE), "immediate").otherwise("none")


def route(kind: Column, hls: Column, detected: Column, role: Column) -> Column:
    """hls, live or artifact; what the response reveals re-routes a current source, and fails a next one."""
    found = detected.isin("hls", "live")
    return F.when(hls, "hls").when(kind == "live", "live").when(found & (role == "current"), detected).when(found, UNSUPPORTED).otherwise("artifact")


def _codecs(codecs: Column) -> Column:
    return F.transform(F.split(F.lower(codecs), ","), lambda c: F.trim(c))


def _of_family(c: Column, families: tuple[str, ...]) -> Column:
    """A codec that is one of these names, or goes on from one with a dot."""
    return F.split_part(c, F.lit("."), F.lit(1)).isin(*families)


def codec_class(codecs: Column) -> Column:
    has = lambda f: F.coalesce(F.exists(_codecs(codecs), f), F.lit(False))
    bad = has(lambda c: c.isin(*UNSUPPORTED_CODECS) | _of_family(c, UNSUPPORTED_FAMILIES))
    return F.when(has(lambda c: c.isin(*VERIFIED_CODECS)), "verified").when(bad, "unsupported").otherwise("unknown")


def codec_rank(codecs: Column) -> Column:
    kind = codec_class(codecs)
    return F.when(kind == "verified", 0).when(kind == "unknown", 1).otherwise(2)


def has_video(codecs: Column) -> Column:
    return F.coalesce(F.exists(_codecs(codecs), lambda c: _of_family(c, VIDEO_FAMILIES)), F.lit(False))


def channel_rank(channels: Column) -> Column:
    """1 for more than two channels, and where the number can't be read."""
    text = F.split_part(channels, F.lit("/"), F.lit(1))
    n = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("int"))
    return F.when(n <= 2, 0).otherwise(1)


def is_gap(tags: Column) -> Column:
    """Does a segment's list of unknown tags hold the gap mark."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == "x-gap"), F.lit(False))


def buffers(frame, prebuffer, capacity, prime, batch, lateness) -> Column:
    all_ = [x <= 0 for x in (frame, prebuffer, capacity, batch)] + [x < 0 for x in (prime, lateness)]
    return F.when(any_of(*all_, batch > 1000, capacity > 10_000, prebuffer > capacity, prime > capacity, lateness > capacity), INVALID_CONFIG)


def encoder(rate, channels, complexity, bitrate, max_packet_bytes=None) -> Column:
    bad = [rate != 48_000, ~channels.between(1, 2), ~complexity.between(0, 10), ~bitrate.between(500, 512_000)]
    if max_packet_bytes is not None:
        bad.append(max_packet_bytes <= 0)
    return F.when(any_of(*bad), INVALID_CONFIG)


def limits(streams, producers, preloads, http, live, tempfile_bytes, cpu_workers=None, live_bytes=None) -> Column:
    bad = [x <= 0 for x in (streams, producers, preloads, live)] + [preloads >= producers, http < 2, tempfile_bytes < 2 << 20]
    if cpu_workers is not None:
        bad += [cpu_workers <= 0, cpu_workers > producers]
    if live_bytes is not None:
        bad.append(~live_bytes.between(1, (1 << 32) - 1))
    return F.when(any_of(*bad), INVALID_CONFIG)


def rtp_output(port, rtcp_port, mtu, payload_type, encryption, mux=None, remote=None, local=None, keepalive_ms=None) -> Column:
    """Null, INVALID_CONFIG, or UNSUPPORTED for a protection that is well formed but can't be sent."""
    bad = [~port.between(1, 65_535), rtcp_port.isNotNull() & ~rtcp_port.between(1, 65_535), ~mtu.between(MIN_MTU, MAX_DATAGRAM), ~payload_type.between(0, 127)]
    bad += [F.trim(encryption) == "", F.octet_length(encryption) > 64]
    if mux is not None:
        bad.append(~mux & rtcp_port.isNull())
    for ip in (remote, local):
        if ip is not None:
            bad += [ip.isNull(), F.trim(ip) == ""]
    if keepalive_ms is not None:
        bad.append(~keepalive_ms.between(MIN_KEEPALIVE_MS, MAX_KEEPALIVE_MS))
    return F.when(any_of(*bad), INVALID_CONFIG).when(encryption != "none", UNSUPPORTED)


def next_source(live: Column, hls: Column, version: Column) -> Column:
    return F.when(any_of(live, hls), UNSUPPORTED).when(~F.coalesce(version > 0, F.lit(False)), INVALID_CONFIG)


def elementary_kind(b: Column) -> Column:
    """aac or mpeg by the first two bytes, else null."""
    at = lambda i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("int")
    sync = at(1) == 0xFF
    return F.when(sync & (at(2).bitwiseAND(0xF6) == 0xF0), "aac").when(sync & (at(2).bitwiseAND(0xE0) == 0xE0), "mpeg")


def segment_iv(method: Column, key_format: Column, versions: Column, iv: Column, media_sequence: Column, initialization: Column) -> tuple[Column, Column]:
    """The IV of an encrypted segment in hex (null for a plain one), and the error.  A segment without one takes its media
    sequence; an initialization map must have one."""
    plain = method.isNull() | (method == "NONE")
    odd = any_of(method != "AES-128", F.lower(key_format) != "identity", F.exists(F.split(versions, "/"), lambda v: F.trim(v) != "1"))
    digits = F.when(iv.rlike(r"^0[xX][0-9A-Fa-f]{1,32}\z"), F.upper(F.substring(iv, 3, 32)))
    bad = any_of(iv.isNull() & initialization, iv.isNotNull() & digits.isNull())
    error = F.when(plain, F.lit(None)).when(odd, UNSUPPORTED).when(bad, INVALID_SOURCE)
    return F.when(~plain & error.isNull(), F.lpad(F.coalesce(digits, F.hex(media_sequence)), 32, "0")), error


def decrypt_segment(body: Column, key: Column, iv: Column, media_sequence: Column) -> Column:
    """AES-128-CBC with PKCS padding; the IV is given in hex (0x...) or is the media sequence.  Null if it can't be."""
    full, _ = segment_iv(F.lit("AES-128"), F.lit(None).cast("string"), F.lit(None).cast("string"), iv, media_sequence, F.lit(False))
    whole = (F.octet_length(key) == 16) & (F.octet_length(body) > 0) & (F.octet_length(body) % 16 == 0)
    out = F.when(whole, F.try_aes_decrypt(F.concat(F.unhex(full), body), key, F.lit("CBC"), F.lit("PKCS")))
    return F.when(F.octet_length(out) > 0, out)

"""Playlist texts as rows: segments, variants and renditions, and the way from a master to what is played.

A playlist is one row of at most a mebibyte; its lines are spread over rows and each tag goes to the address that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rules as R
from . import streams as S

MOST_BYTES, MOST_DEPTH = 1 << 20, 3


def attribute(line: Column, name: str) -> Column:
    """A tag's attribute, without its quotes; null if it isn't there."""
    found = F.regexp_extract(line, rf'(?:^#[^:]*:|,)\s*{name}=("[^"]*"|[^",]*)', 1)
    return F.when(found != "", F.trim(found, F.lit('"')))


def url_join(base: Column, ref: Column) -> Column:
    """A reference resolved against an address: absolute, //host, /path, ?query or relative, without dot pieces."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    full = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref == "", base).when(ref.startswith("?"), F.concat(origin, path, ref)).otherwise(F.concat(origin, folder, ref))
    )
    return R.bound(full, _without_dots)


def _without_dots(url: Column) -> Column:
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    pieces = F.split(F.regexp_replace(part(2), "^/", ""), "/")
    # Each piece joins the list, is dropped (.), or takes the last with it (..); a dot piece at the end leaves a slash.
    last = F.element_at(pieces, -1)
    up = F.aggregate(
        pieces, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    )
    path = F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(up, F.array(F.lit("")))).otherwise(up), "/"))
    return F.when(url.rlike(r"://[^/?#]*/.*\.(/|$|\?|#)") | url.rlike(r"/\.\.?(/|$|\?|#)"), F.concat(part(1), path, part(3))).otherwise(url)


def _lines(playlists: DataFrame, key: str) -> DataFrame:
    """key, n, line, place: the address line to which each line belongs, from 1."""
    own = playlists.select(key, F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    is_uri = (F.col("line") != "") & ~F.col("line").startswith("#")
    w = Window.partitionBy(key).orderBy("n")
    before = F.coalesce(F.sum(is_uri.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumns({"is_uri": is_uri, "place": before + 1})


def media_segments(playlists: DataFrame, key: str) -> DataFrame:
    """The segments of media playlists (key, text): key, idx, uri, seconds, sequence, discontinuity, gap, range_len,
    range_off, key_tag and map_tag (inherited), end_list, target_seconds."""
    lines, line = _lines(playlists, key), F.col("line")
    tag = lambda name: F.when(line.startswith(f"#EXT{name}"), line)
    value = lambda c: F.regexp_extract(c, r"^[^:]*:(.*)$", 1)
    one = lambda name: F.max_by(line, F.when(line.startswith(f"#EXT{name}"), F.col("n")))
    own = lines.groupBy(key, F.col("place").alias("idx")).agg(
        F.max(F.when(F.col("is_uri"), line)).alias("uri"), value(one("INF:")).alias("inf"), value(one("-X-BYTERANGE:")).alias("span"), one("-X-KEY:").alias("key_tag"), one("-X-MAP:").alias("map_tag"),
        F.bool_or(line.startswith("#EXT-X-DISCONTINUITY") & ~line.startswith("#EXT-X-DISCONTINUITY-")).alias("discontinuity"), F.bool_or(F.upper(line) == "#EXT-X-GAP").alias("gap"),
        F.max(value(tag("-X-MEDIA-SEQUENCE:")).try_cast("long")).alias("first"), F.max(value(tag("-X-TARGETDURATION:")).try_cast("long")).alias("target_seconds"), F.bool_or(line.startswith("#EXT-X-ENDLIST")).alias("end_list"),
    )
    # What holds for the whole playlist stands anywhere in it; tags after the last address belong to none.
    whole = Window.partitionBy(key)
    held = lambda c: S.as_of(own, key, ["idx"], F.col(c))
    own = own.withColumns({"first": F.max("first").over(whole), "target_seconds": F.max("target_seconds").over(whole), "end_list": F.bool_or("end_list").over(whole), "key_tag": held("key_tag"), "map_tag": held("map_tag")})
    own = own.where("uri IS NOT NULL")
    part = lambda i: F.try_element_at(F.split("span", "@"), F.lit(i)).try_cast("long")
    return own.select(
        key, F.col("idx").cast("long").alias("idx"), "uri", F.split_part("inf", F.lit(","), F.lit(1)).try_cast("double").alias("seconds"), (F.coalesce("first", F.lit(0)) + F.col("idx") - 1).alias("sequence"),
        "discontinuity", "gap", part(1).alias("range_len"), part(2).alias("range_off"), "key_tag", "map_tag", "end_list", "target_seconds",
    )


def is_master(text: Column) -> Column:
    return text.rlike(r"(^|\n)\s*#EXT-X-(STREAM-INF|MEDIA|I-FRAME-STREAM-INF):")


def variants(playlists: DataFrame, key: str) -> DataFrame:
    """The variants of master playlists, as ``choose_media`` takes them."""
    lines, line = _lines(playlists, key), F.col("line")
    tags = lines.where(line.startswith("#EXT-X-STREAM-INF:") | line.startswith("#EXT-X-I-FRAME-STREAM-INF:"))
    uris = lines.where("is_uri").select(key, "place", line.alias("uri"))
    met = tags.join(uris, [key, "place"], "left")
    frame, codecs = line.startswith("#EXT-X-I-FRAME"), attribute(line, "CODECS")
    return met.select(
        key, F.col("n").alias("ord"), F.coalesce(attribute(line, "URI"), "uri").alias("uri"), attribute(line, "AUDIO").alias("audio_group"), attribute(line, "BANDWIDTH").try_cast("long").alias("bandwidth"),
        R.codec_rank(codecs).alias("rank"), (R.has_video(codecs) | attribute(line, "RESOLUTION").isNotNull() | attribute(line, "VIDEO").isNotNull()).alias("has_video"), frame.alias("is_i_frame"),
    )


def renditions(playlists: DataFrame, key: str) -> DataFrame:
    """The audio renditions of master playlists, as ``choose_media`` takes them."""
    line = F.col("line")
    yes = lambda name: F.coalesce(attribute(line, name) == "YES", F.lit(False))
    return _lines(playlists, key).where(line.startswith("#EXT-X-MEDIA:") & (attribute(line, "TYPE") == "AUDIO")).select(
        key, F.col("n").alias("ord"), attribute(line, "URI").alias("uri"), attribute(line, "GROUP-ID").alias("audio_group"), yes("DEFAULT").alias("is_default"), yes("AUTOSELECT").alias("autoselect"),
        R.channel_rank(attribute(line, "CHANNELS")).alias("channel_rank"),
    )


def selected(playlists: DataFrame, key: str) -> DataFrame:
    """key, uri: what each master playlist leads to."""
    v, r = variants(playlists, key), renditions(playlists, key)
    every = v.select(key, "ord", "uri").unionByName(r.select(key, "ord", "uri"))
    return S.choose_media(v, r, key, "ord").join(every, [key, "ord"]).select(key, "uri")


def resolve(requests: DataFrame, playlists: DataFrame) -> DataFrame:
    """id, url, depth, error: from each request (id, url) over master playlists (url, text) to a media playlist, at most
    MOST_DEPTH texts deep."""
    masters = playlists.where(is_master(F.col("text")))
    onward = selected(masters, "url").select("url", url_join(F.col("url"), F.col("uri")).alias("_next"))
    known = playlists.select("url", is_master(F.col("text")).alias("_master")).join(onward, "url", "left")
    now = requests.select("id", "url", F.lit(0).alias("depth"), F.lit(True).alias("_open"), F.lit(None).cast("string").alias("error"))
    for _ in range(MOST_DEPTH):
        met = now.join(known, "url", "left")
        missing = F.col("_open") & F.col("_master").isNull()
        stuck = F.col("_open") & F.col("_master") & F.col("_next").isNull()
        goes = F.col("_open") & F.coalesce(F.col("_master"), F.lit(False)) & F.col("_next").isNotNull()
        now = met.select(
            "id", F.when(goes, F.col("_next")).otherwise(F.col("url")).alias("url"), (F.col("depth") + F.col("_open").cast("int")).alias("depth"), goes.alias("_open"),
            F.coalesce("error", F.when(missing, "INVALID_SOURCE").when(stuck, "UNSUPPORTED")).alias("error"),
        )
    failed = F.coalesce("error", F.when(F.col("_open"), "INVALID_SOURCE"))
    return now.select("id", F.when(failed.isNull(), F.col("url")).alias("url"), "depth", failed.alias("error"))


def delivery(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """By playlist what is delivered (map: the initialization map or null, kind: of the bytes or null): delivered, gaps,
    stopped_at and error.  Gaps are skipped; a map that changes, comes or goes midstream stops it, and so does a new kind."""
    own = segments.where(~F.col("gap"))
    w = Window.partitionBy(key).orderBy(*order)
    odd_map = ~F.col("map").eqNullSafe(F.first("map").over(w))
    odd_kind = F.col("kind") != F.first("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.struct(*order)
    own = own.withColumn("_bad", odd_map | F.coalesce(odd_kind, F.lit(False)))
    first = own.withColumn("_stop", F.min(F.when(F.col("_bad"), at)).over(Window.partitionBy(key)))
    out = first.groupBy(key).agg(F.count_if(F.col("_stop").isNull() | (at < F.col("_stop"))).alias("delivered"), F.first("_stop").alias("_stop"))
    gaps = segments.groupBy(key).agg(F.count_if("gap").alias("gaps"))
    met = gaps.join(out, key, "left")
    return met.select(key, F.coalesce("delivered", F.lit(0)).alias("delivered"), "gaps", F.col(f"_stop.{order[-1]}").alias("stopped_at"), F.when(F.col("_stop").isNotNull(), "UNSUPPORTED").alias("error"))


def reloads(snapshots: DataFrame, key: str, order: list[str], depth: int = 3) -> DataFrame:
    """What successive snapshots of a playlist (media_sequence, uris, target, end_list) hand on: each new segment once, and a row
    for each span that the playlist has moved past before it was read.

    The first snapshot of a live playlist begins ``depth`` segments before its end; after an end list nothing comes.  Columns:
    key, the last of ``order``, kind (segment or skipped), sequence (the first), n, uri, reload_ms (null after the end)."""
    n = F.size("uris").cast("long")
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first, end = F.col("media_sequence").cast("long"), F.col("media_sequence").cast("long") + n
    own = snapshots.withColumns({"_first": first, "_end": end, "_over": F.coalesce(F.bool_or("end_list").over(before), F.lit(False)), "_known": F.max(end).over(before)})
    begun = F.when(F.col("end_list"), F.col("_first")).otherwise(F.greatest(F.col("_first"), F.col("_end") - depth))
    own = own.where(~F.col("_over")).withColumn("_from", F.coalesce("_known", begun))
    skipped = F.when(F.col("_from") < F.col("_first"), F.array(F.struct(F.lit("skipped").alias("kind"), F.col("_from").alias("sequence"), (F.col("_first") - F.col("_from")).alias("n"), F.lit(None).cast("string").alias("uri"))))
    start = F.greatest("_from", "_first")
    fresh = F.transform(
        F.when(start < F.col("_end"), F.sequence(start, F.col("_end") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda s: F.struct(F.lit("segment").alias("kind"), s.alias("sequence"), F.lit(1).cast("long").alias("n"), F.get("uris", (s - F.col("_first")).cast("int")).alias("uri")),
    )
    reload_ms = F.when(~F.col("end_list"), N.reload_delay_ms(F.col("target").cast("long")))
    out = own.select(key, order[-1], reload_ms.cast("long").alias("reload_ms"), F.explode(F.concat(F.coalesce(skipped, F.array().cast("array<struct<kind:string,sequence:bigint,n:bigint,uri:string>>")), fresh)).alias("x"))
    return out.select(key, order[-1], "x.*", "reload_ms")

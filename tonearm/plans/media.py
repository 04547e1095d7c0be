"""Queries over containers and codecs: the tables' rows are stored as files and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numbers as N
from ..operators import resampling as R
from ..operators import streams as S
from ..sources import ogg
from ..sources import tables as T
from ..sources.batches import pieces, small_batches
from .catalogue import query, read


def little(x: Column, width: int) -> Column:
    """An integer as little-endian bytes in hex."""
    u = F.pmod(x, F.lit(1 << 8 * width))
    return F.concat(*[F.lpad(F.hex(F.pmod(F.shiftright(u, 8 * i), F.lit(256))), 2, "0") for i in range(width)])


def wav(samples: Column, rate: int, channels: int = 1) -> Column:
    """16-bit samples as a WAV file."""
    data = F.array_join(F.transform(samples, lambda x: little(F.floor(x.cast("double") * 32768 + 0.5).cast("long"), 2)), "")
    n = F.size(samples).cast("long") * 2
    form = "666D7420" + "10000000" + "0100" + f"{channels:02X}00" + rate.to_bytes(4, "little").hex() + (2 * channels * rate).to_bytes(4, "little").hex() + f"{2 * channels:02X}00" + "1000"
    return F.unhex(F.concat(F.lit("52494646"), little(n + 36, 4), F.lit("57415645" + form + "64617461"), little(n, 4), data))


_QUANTIZED = "list_transform(embedding, lambda x: floor(x::DOUBLE * 32768 + 0.5) / 32768)"


@query(f"""SELECT vec_id, CASE WHEN vec_id % 10 > 0 THEN least(vec_id % 4 * 16, len(embedding)) END AS first_frame,
  CASE WHEN vec_id % 10 > 0 THEN 16000 END::BIGINT AS sample_rate, CASE WHEN vec_id % 10 > 0 THEN {_QUANTIZED}[vec_id % 4 * 16 + 1:] END AS samples, CASE WHEN vec_id % 10 = 0 THEN CASE WHEN vec_id % 20 = 0 THEN 'INVALID_SOURCE' ELSE 'DECODE_ERROR' END END AS error FROM embeddings""")
def wav_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sound files of 16 kHz, read from 0 to 3 ms on; some are empty, some no sound."""
    i = F.col("vec_id")
    body = F.when(i % 20 == 0, F.lit("").cast("binary")).when(i % 10 == 0, F.lit("text").cast("binary")).otherwise(wav(F.col("embedding"), 16_000))
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", (i % 4).alias("at_ms"), body.alias("content"))
    out = T.decode_from(e, "at_ms")
    return out.select("vec_id", "first_frame", F.col("sample_rate").cast("long").alias("sample_rate"), F.transform("samples", lambda x: x.cast("double")).alias("samples"), "error")


def transport(text: Column, broken: Column) -> Column:
    """Bytes (in hex) as packets of one audio stream, a 170-byte piece in each, stuffed to their size; a broken one lacks its
    second packet."""
    pieces = F.greatest(N.idiv(F.length(text) + 339, 340), F.lit(1).cast("long"))

    def packet(i: Column) -> Column:
        body = F.concat(F.when(i == 0, "000001C00000800000").otherwise(""), F.substring(text, (i * 340 + 1).cast("int"), F.lit(340)))
        room = F.lit(183) - N.idiv(F.length(body), 2)  # the adaptation field's own length
        stuffing = F.concat(F.lpad(F.hex(room), 2, "0"), F.when(room > 0, F.concat(F.lit("00"), F.repeat(F.lit("FF"), (room - 1).cast("int")))).otherwise(""))
        return F.concat(F.lit("47"), F.when(i == 0, "4101").otherwise("0101"), F.lit("3"), F.hex(i % 16), stuffing, body)

    numbers = F.filter(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda i: ~(broken & (i == 1)))
    return F.unhex(F.array_join(F.transform(numbers, packet), ""))


@query("""SELECT page_id, CASE WHEN NOT lost THEN n END AS n_bytes, CASE WHEN NOT lost THEN md5(html) END AS digest, CASE WHEN lost THEN 'DECODE_ERROR' END AS error
FROM (SELECT page_id, html, octet_length(encode(html)) AS n, page_id % 5 = 0 AND octet_length(encode(html)) > 340 AS lost FROM pages WHERE html IS NOT NULL AND html <> '')""")
def transport_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as transport streams; some have lost a packet, which only a later one shows."""
    p = read(spark, sf_dir, "pages", "page_id", "html").where("html IS NOT NULL AND html <> ''")
    # A stream of two packets is left whole: without its last one it would only be short.
    broken = (F.col("page_id") % 5 == 0) & (F.octet_length("html") > 340)
    out = T.demultiplexed(p.select("page_id", transport(F.hex(F.col("html").cast("binary")), broken).alias("content")))
    return out.select("page_id", F.octet_length("audio").cast("long").alias("n_bytes"), F.md5("audio").alias("digest"), "error")


@query("""SELECT page_id, k.boxes, k.decision, k.init_ok, k.fragment_ok FROM pages JOIN (VALUES (0, ['ftyp', 'moov'], 'progressive', true, false), (1, ['ftyp', 'mdat'], 'artifact', false, false), (2, ['moov'], 'artifact', false, false), (3, ['styp', 'moof', 'mdat'], 'artifact', false, true),
  (4, ['mdat', 'moof'], 'artifact', false, false), (5, NULL, 'pending', false, false), (6, ['ftyp', 'free', 'moov', 'mdat'], 'progressive', true, false), (7, ['ftyp'], 'pending', false, false)) AS k(k, boxes, decision, init_ok, fragment_ok) ON page_id % 8 = k.k""")
def box_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda kind, n=4: F.concat(F.lit((8 + n).to_bytes(4, "big").hex() + kind.encode().hex()), F.lit("00" * n))
    heads = [
        F.concat(box("ftyp"), box("moov")), F.concat(box("ftyp"), box("mdat")), box("moov"), F.concat(box("styp"), box("moof"), box("mdat")), F.concat(box("mdat"), box("moof")),
        F.concat(box("ftyp"), F.lit("00000100" + b"moov".hex())), F.concat(box("ftyp"), box("free", 90), box("moov"), box("mdat")), box("ftyp"),
    ]
    p = read(spark, sf_dir, "pages", "page_id").select("page_id", F.unhex(F.element_at(F.array(*heads), (F.col("page_id") % 8 + 1).cast("int"))).alias("content"))
    return T.probed(p).drop("error")


def conversion_sql(source: int, target: int, channels: int) -> str:
    """Every label's vectors joined into one stream (of each the first vec_id % 65 values, whole frames), and each output as a sum
    over the frames about it; the filter is said by its formula, as a parabola through three entries of its table."""
    half, n = R.TAPS // 2, R.OVERSAMPLING
    a, b, c = R.CUTOFF_FIT
    cut = f"(1 / (1 + {a}::DOUBLE / {R.TAPS} + {b}::DOUBLE / {R.TAPS**2} + {c}::DOUBLE / {R.TAPS**3}) * least(1, {target} / {source}::DOUBLE))"
    d = f"(e / {n}::DOUBLE)"
    h = f"CASE WHEN e = 0 THEN 1 ELSE sin(pi() * {cut} * {d}) / (pi() * {cut} * {d}) END * pow(0.42 + 0.5 * cos(pi() * {d} / {half}) + 0.08 * cos(2 * pi() * {d} / {half}), 2)"
    return f"""WITH h AS (SELECT e, {h} AS y FROM range({-half * n}, {half * n}) t(e)), u AS (SELECT e, y * {n} / (SELECT sum(y) FROM h) AS y FROM h),
s AS (SELECT label, vec_id, unnest(range(0, len(v))) AS i, unnest(v)::DOUBLE AS x FROM (SELECT label, vec_id, embedding[1:vec_id % 65 // {channels} * {channels}] AS v FROM embeddings)),
m AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS t, x FROM s),
f AS (SELECT label, t // {channels} AS frame, t % {channels} AS channel, x FROM m),
k AS (SELECT label, unnest(range(0, ((max(frame) + 1) * {target} + {source - 1}) // {source})) AS k FROM f GROUP BY label),
o AS (SELECT label, k, k * {source} // {target} AS frame, k * {source} % {target} AS r FROM k),
w AS (SELECT r, o, coalesce(a.y, 0) + (-3 * coalesce(a.y, 0) + 4 * coalesce(b.y, 0) - coalesce(c.y, 0)) / 2 * x + (coalesce(a.y, 0) - 2 * coalesce(b.y, 0) + coalesce(c.y, 0)) / 2 * x * x AS y
  FROM (SELECT r, o, floor(r * {n} / {target}::DOUBLE)::BIGINT - {n} * o AS e, r * {n} / {target}::DOUBLE - floor(r * {n} / {target}::DOUBLE) AS x FROM (SELECT DISTINCT r FROM o), range({-half - 1}, {half + 2}) t(o)) z
  LEFT JOIN u a ON a.e = z.e LEFT JOIN u b ON b.e = z.e + 1 LEFT JOIN u c ON c.e = z.e + 2)
SELECT o.label, o.k AS frame, f.channel, round(sum(f.x * w.y), 6) AS sample FROM o JOIN w ON w.r = o.r JOIN f ON f.label = o.label AND f.frame = o.frame + w.o GROUP BY ALL"""


def conversion(spark: SparkSession, sf_dir: str, source: int, target: int, channels: int) -> DataFrame:
    n = (N.idiv(F.col("vec_id") % 65, channels) * channels).cast("int")
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select("label", "vec_id", F.slice("embedding", F.lit(1), n).alias("samples"), F.lit(source).alias("sample_rate"))
    out = R.resampled(e, ["label"], ["vec_id"], target, channels).where("error IS NULL")
    each = out.select("label", "position", F.posexplode("samples").alias("i", "x"))
    return each.select("label", (F.col("position") + N.idiv(F.col("i"), channels)).alias("frame"), (F.col("i") % channels).cast("long").alias("channel"), N.rounded(F.col("x"), 6).alias("sample"))


@query(conversion_sql(44_100, 48_000, 1))
def rate_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of chunks of 0 to 64 frames at 48 kHz: as if each had been converted whole."""
    return conversion(spark, sf_dir, 44_100, 48_000, 1)


@query(conversion_sql(48_000, 32_000, 2))
def rate_conversion_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To a lower rate, where the filter cuts at the lower band's end."""
    return conversion(spark, sf_dir, 48_000, 32_000, 2)


@query("""WITH s AS (SELECT label, vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS t, greatest(least(floor(floor(x * 32768 + 0.5) / 32768 * 32768 + 0.5), 32767), -32768)::BIGINT AS v FROM s),
f AS (SELECT label, t // 480 AS frame, count(*) AS n, string_agg(lpad(lower(to_hex(((v % 256) + 256) % 256)), 2, '0') || lpad(lower(to_hex((((v - ((v % 256) + 256) % 256) // 256) % 256 + 256) % 256)), 2, '0'), '' ORDER BY t) AS h FROM m GROUP BY ALL)
SELECT label, frame::BIGINT AS frame, (65000 + frame) % 65536 AS sequence, (4294960000 + frame * 480) % 4294967296 AS rtp_timestamp, md5(unhex(h || repeat('0000', 480 - n))) AS digest FROM f""")
def transcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, decoded, framed, encoded and numbered: the whole way of a track."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select("vec_id", "label", wav(F.col("embedding"), 48_000).alias("content"))
    chunks = T.decode_from(e).select("label", "vec_id", F.transform("samples", lambda x: x.cast("double")).alias("samples"))
    frames = S.count_windows(chunks, "label", ["vec_id"], "samples", 480)
    packets = T.encoded(frames.select("label", "frame", A.apply_volume(F.col("samples"), 1.0).alias("samples")), "pcm16")
    return packets.select("label", "frame", N.wrap(F.col("frame") + 65_000, N.U16).alias("sequence"), N.wrap(F.col("frame") * 480 + 4_294_960_000).alias("rtp_timestamp"), F.md5("packet").alias("digest"))


def page_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and content: each page's html in packets of 700 bytes, as Ogg pages of four segments; of some the second is broken."""
    import pyarrow as pa

    def run(batches):
        for batch in pieces(batches, "html"):
            out = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                data = ogg.write_stream([(html[i : i + 700], i + 700) for i in range(0, len(html) + 1, 700)], page_id % 1000, 4)
                # The second page's checksum: its place is told by the first page's lacing, and a page of any length has one.
                at = 27 + data[26] + sum(data[27 : 27 + data[26]]) + 22
                if page_id % 3 == 0 and at < len(data):
                    data = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], names=["page_id", "content"])

    small_batches(spark)
    p = read(spark, sf_dir, "pages", "page_id", "html").groupBy("page_id").agg(F.any_value("html", ignoreNulls=True).alias("html"))
    return p.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("html")).mapInArrow(run, "page_id long, content binary")


@query("""WITH p AS (SELECT page_id, encode(coalesce(any_value(html), '')) AS b FROM pages GROUP BY page_id), k AS (SELECT page_id, b, unnest(range(0, octet_length(b) // 700 + 1)) AS j FROM p),
s AS (SELECT page_id, j, least(octet_length(b) - 700 * j, 700) AS n, hex(b)[1400 * j + 1:1400 * j + 1400] AS h FROM k), t AS (SELECT *, 3 * j AS first, 3 * j + n // 255 AS last, max(3 * j + n // 255) OVER (PARTITION BY page_id) AS ends FROM s)
SELECT page_id, last // 4 AS sequence, n AS n_bytes, md5(unhex(h)) AS digest, CASE WHEN row_number() OVER (PARTITION BY page_id, last // 4 ORDER BY j DESC) = 1 THEN 700 * j + 700 END AS granule, NULL::VARCHAR AS error FROM t WHERE NOT (page_id % 3 = 0 AND ends > 3 AND first < 8 AND last > 3)
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, 'DECODE_ERROR' FROM t WHERE page_id % 3 = 0 AND ends > 3 GROUP BY page_id""")
def ogg_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of those streams; those that a broken page had a part of are gone, and it is a row."""
    out = ogg.packets(page_streams(spark, sf_dir), "page_id")
    return out.select("page_id", "sequence", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"), "granule", "error")


@query("""WITH e AS (SELECT user_id, event_id, 120 * (1 + event_id % 8) AS frames, user_id * 37 % 700 AS skip FROM events), s AS (SELECT *, sum(frames) OVER (PARTITION BY user_id ORDER BY event_id) AS so_far, sum(frames) OVER (PARTITION BY user_id) - user_id % 500 AS last FROM e),
t AS (SELECT *, least(greatest(skip - (so_far - frames), 0), frames)::BIGINT AS start FROM s)
SELECT user_id, event_id, start, least(greatest(so_far - last, 0), frames - start)::BIGINT AS "end", (frames - start - least(greatest(so_far - last, 0), frames - start))::BIGINT AS retained FROM t""")
def packet_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of 120 to 960 frames: each stream's first frames and those past its last granule are trimmed."""
    from pyspark.sql import Window

    frames, w = 120 * (1 + F.col("event_id") % 8), Window.partitionBy("user_id")
    e = read(spark, sf_dir, "events", "user_id", "event_id").withColumn("frames", frames)
    granule = F.when(F.col("event_id") == F.max("event_id").over(w), F.sum("frames").over(w) - F.col("user_id") % 500)
    out = ogg.trims(e.withColumn("granule", granule), "user_id", ["event_id"], "frames", "granule", F.col("user_id") * 37 % 700)
    return out.select("user_id", "event_id", "start", "end", "retained")

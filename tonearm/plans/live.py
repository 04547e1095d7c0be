"""Queries over whole logs as single streams, deadlines with epochs, playlist reloads, seeks and redirect chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import delivery as D
from ..operators import playlists as P
from ..operators import redirects, seeks, stages
from ..operators import streams as S
from ..operators.scans import scan
from ..sources import boxes as B
from .catalogue import LINES, LINES_SQL, query, read
from .media import transport


@query("""
WITH e AS (SELECT event_id, ts, event_type, event_id * 7919 % 1000 AS x, CASE WHEN event_type = 'signup' THEN event_id % 3 END AS g FROM events)
SELECT event_id, greatest(x - coalesce(lag(x) OVER w, x), 0) AS delta, last_value(g IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS generation,
  (lag(x % 16) OVER w + 1) % 16 = x % 16 AS follows, (sum(x) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS total, max(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
FROM e WINDOW w AS (ORDER BY ts, event_id)""")
def one_stream_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream: counter deltas, the generation as of each, continuity, running sum and maximum, in many tasks."""
    i = F.col("event_id")
    e = read(spark, sf_dir, "events", "event_id", "ts", "event_type").select("event_id", "ts", (i * 7919 % 1000).alias("x"), F.when(F.col("event_type") == "signup", i % 3).alias("g"))
    x = F.col("x")
    out = scan(e, [], ["ts", "event_id"], sums={"total": x}, lasts={"generation": F.col("g")}, befores={"_x": x}, maxima={"best_before": x})
    delta = F.greatest(x - F.coalesce("_x", x), F.lit(0).cast("long"))
    return out.select("event_id", delta.alias("delta"), "generation", ((F.col("_x") % 16 + 1) % 16 == x % 16).alias("follows"), "total", "best_before")


@query("""WITH s AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT row_number() OVER (ORDER BY vec_id, i) - 1 AS t, x FROM s)
SELECT (t // 960)::BIGINT AS frame, (t // 960 * 960)::BIGINT AS position, count(*)::BIGINT AS n_values, round(sum(x), 6) AS total, first(x ORDER BY t) AS first, last(x ORDER BY t) AS last FROM m GROUP BY t // 960""")
def one_stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one stream of samples, in frames of 960."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.lit(0).alias("stream"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    out = S.count_windows(e, "stream", ["vec_id"], "x", 960, long=True)
    n = F.col("n_values")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return out.select("frame", "position", n.cast("long").alias("n_values"), N.rounded(total, 6).alias("total"), F.get("samples", F.lit(0)).alias("first"), F.get("samples", n - 1).alias("last"))


_DEADLINES = """SELECT user_id, event_id AS n, event_id * 20 AS ms, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'ready' WHEN 'purchase' THEN 'pause' WHEN 'click' THEN 'resume' ELSE CASE WHEN event_id % 7 = 0 THEN 'stop' ELSE 'failed' END END AS kind,
  CASE event_id // 2 % 2 WHEN 0 THEN 'current' ELSE 'next' END AS role, event_id % 2 AS generation FROM events"""


@query(f"""WITH l AS ({_DEADLINES}), g AS (SELECT * FROM l WHERE kind IN ('pause', 'resume', 'stop')), o AS (SELECT * FROM l WHERE kind NOT IN ('pause', 'resume', 'stop')),
before AS (SELECT l.user_id, l.n, arg_max(g.kind, g.n) AS last FROM l JOIN g ON g.user_id = l.user_id AND g.n < l.n GROUP BY ALL),
arms AS (
  SELECT s.user_id, s.role, s.generation, s.n AS attempt, s.n, s.ms FROM o s LEFT JOIN before b ON b.user_id = s.user_id AND b.n = s.n WHERE s.kind = 'start' AND coalesce(b.last, '') <> 'pause'
  UNION ALL SELECT s.user_id, s.role, s.generation, s.n, r.n, r.ms FROM g r JOIN before b ON b.user_id = r.user_id AND b.n = r.n AND b.last = 'pause' JOIN o s ON s.user_id = r.user_id AND s.kind = 'start' AND s.n < r.n
    WHERE r.kind = 'resume' AND NOT EXISTS (SELECT 1 FROM l x WHERE x.user_id = s.user_id AND x.n > s.n AND x.n < r.n AND (x.kind = 'stop' OR (x.role = s.role AND (x.kind = 'start' OR (x.kind IN ('ready', 'failed') AND x.generation = s.generation)))))),
late AS (SELECT * FROM arms a WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.user_id = a.user_id AND x.n > a.n AND x.ms <= a.ms + 4000 AND (x.kind IN ('pause', 'stop') OR (x.role = a.role AND (x.kind = 'start' OR (x.kind IN ('ready', 'failed') AND x.generation = a.generation))))))
SELECT user_id, role, generation, (SELECT count(*) FROM l x WHERE x.user_id = a.user_id AND x.n <= a.n AND (x.kind IN ('pause', 'resume') OR (x.kind = 'start' AND x.role = a.role))) AS epoch, ms + 4000 AS due, 'SOURCE_TIMEOUT' AS code
FROM late a QUALIFY row_number() OVER (PARTITION BY user_id, attempt ORDER BY n) = 1""")
def deadline_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of both roles that don't become ready in time, with pauses that make deadlines stale and resumes that arm them anew."""
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "signup", "start").when(t == "view", "ready").when(t == "purchase", "pause").when(t == "click", "resume").otherwise(F.when(i % 7 == 0, "stop").otherwise("failed"))
    role = F.when(N.idiv(i, 2) % 2 == 0, "current").otherwise("next")
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select("user_id", "event_id", (i * 20).alias("ms"), kind.alias("kind"), role.alias("role"), (i % 2).alias("generation"))
    return D.deadlines(e, "user_id", ["event_id"], "ms", 4000)


@query(f"""WITH RECURSIVE s AS (SELECT l_orderkey AS playlist, idx, idx * 2 + l_partkey % 5 + CASE WHEN l_suppkey % 6 = 0 THEN 4 ELSE 0 END AS first, l_quantity::BIGINT % 5 AS n, l_quantity::BIGINT % 12 AS target, l_suppkey % 13 = 0 AS ends
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES_SQL}) AS idx FROM lineitem)),
r AS (SELECT playlist, 0::BIGINT AS idx, NULL::BIGINT AS next, false AS ended, NULL::BIGINT AS begun, NULL::BIGINT AS first, 0::BIGINT AS n, 0::BIGINT AS target, false AS ends FROM s GROUP BY playlist
  UNION ALL SELECT s.playlist, s.idx, greatest(begun_, s.first + s.n, s.first), s.ends, begun_, s.first, s.n, s.target, s.ends FROM r JOIN s ON s.playlist = r.playlist AND s.idx = r.idx + 1 AND NOT r.ended,
    LATERAL (SELECT coalesce(r.next, CASE WHEN s.ends THEN s.first ELSE greatest(s.first, s.first + s.n - 3) END) AS begun_) b),
x AS (SELECT playlist, idx, 'skipped' AS kind, begun AS sequence, first - begun AS n, NULL::VARCHAR AS uri, target, ends FROM r WHERE idx > 0 AND begun < first
  UNION ALL SELECT playlist, idx, 'segment', unnest(range(greatest(begun, first), first + n)), 1, NULL, target, ends FROM r WHERE idx > 0)
SELECT playlist, idx, kind, sequence, n, CASE kind WHEN 'segment' THEN 'seg' || sequence END AS uri, CASE WHEN NOT ends THEN least(greatest(target * 500, 500), 5000) END AS reload_ms FROM x""")
def playlist_reloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as snapshots of a playlist that moves on, jumps or goes back: what they hand on, once."""
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINES)).cast("long")
    first = F.col("idx") * 2 + F.col("l_partkey") % 5 + F.when(F.col("l_suppkey") % 6 == 0, 4).otherwise(0)
    quantity = F.col("l_quantity").cast("long")
    li = read(spark, sf_dir, "lineitem", "l_orderkey", *LINES).withColumn("idx", idx).withColumn("media_sequence", first)
    uris = F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), (quantity % 5).cast("int")), lambda j: F.concat(F.lit("seg"), (F.col("media_sequence") + j).cast("string")))
    own = li.select(F.col("l_orderkey").alias("playlist"), "idx", "media_sequence", uris.alias("uris"), (quantity % 12).alias("target"), (F.col("l_suppkey") % 13 == 0).alias("end_list"))
    return P.reloads(own, "playlist", ["idx"])


@query("""WITH m AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS t, x FROM (SELECT label, vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM (SELECT label, vec_id, embedding[1:vec_id % 65] AS v FROM embeddings))),
q AS (SELECT event_id, event_id % 10 AS label, event_id * 7919 % 400 * 16000 // 1000 AS first, 1 + user_id % 300 AS n FROM events),
s AS (SELECT q.event_id, count(m.t) AS n_frames, md5(string_agg(floor(m.x::DOUBLE * 32768 + 0.5)::BIGINT, ',' ORDER BY m.t)) AS digest FROM q JOIN m ON m.label = q.label AND m.t >= q.first AND m.t < q.first + q.n GROUP BY q.event_id)
SELECT q.event_id, q.label, q.first AS first_frame, coalesce(n_frames, 0) AS n_frames, coalesce(digest, md5('')) AS digest FROM q LEFT JOIN s ON s.event_id = q.event_id""")
def seek_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for up to 300 frames from a time on, some past the end, over streams of chunks of 0 to 64 frames."""
    i = F.col("event_id")
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.col("label").cast("long").alias("label"), "vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 65).cast("int")).alias("samples"), F.lit(16_000).alias("sample_rate"))
    chunks = seeks.placed(e, "label", ["vec_id"])
    asked = read(spark, sf_dir, "events", "event_id", "user_id").select("event_id", (i % 10).alias("label"), (i * 7919 % 400).alias("at_ms"), (F.col("user_id") % 300 + 1).alias("n_frames"))
    out = seeks.seek(asked, chunks, "label", "event_id")
    digest = F.md5(F.array_join(F.transform("samples", lambda x: F.floor(x.cast("double") * 32768 + 0.5).cast("string")), ",").cast("binary"))
    return out.select("event_id", "label", "first_frame", "n_frames", digest.alias("digest"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT page_id AS i FROM pages), n AS (SELECT count(*) AS n FROM p),
h AS (SELECT i, CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 0 THEN '//h' || (i * 3 + 1) % n || '.example/f' WHEN i % 13 = 0 THEN 'http://h' || (i + 5) % n || '.example/f' WHEN i % 17 = 0 THEN 'https://10.0.0.' || i % 250 || '/f' ELSE 'https://h' || (i * 3 + 1) % n || '.example/f' END AS location FROM p, n),
u AS (SELECT 'https://h' || i || '.example/f' AS url, CASE WHEN location LIKE '//%' THEN 'https:' || location ELSE location END AS target, location FROM h),
c AS (SELECT i, i % 2 = 0 AS public_only, 'https://h' || i || '.example/f' AS url, 0 AS hops, NULL::VARCHAR AS error, true AS open FROM p
  UNION ALL SELECT c.i, c.public_only, CASE WHEN bad THEN c.url ELSE target END, c.hops + (NOT bad)::INTEGER, CASE WHEN bad THEN 'INVALID_SOURCE' END, NOT bad
    FROM c JOIN (SELECT url AS at, target FROM u WHERE target IS NOT NULL) u ON u.at = c.url,
      LATERAL (SELECT c.hops >= 9 OR (c.public_only AND (target LIKE 'http:%' OR target LIKE 'https://10.%')) AS bad) b WHERE c.open)
SELECT i AS page_id, CASE WHEN error IS NULL THEN url END AS url, hops, error FROM c QUALIFY row_number() OVER (PARTITION BY i ORDER BY hops DESC, error NULLS LAST) = 1""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address and where it is sent on, to relative, plain and private addresses too; half the requests are public-only."""
    p = read(spark, sf_dir, "pages", "page_id").select(F.col("page_id").alias("i")).distinct()
    n, i, text = p.count(), F.col("i"), lambda c: c.cast("string")
    address = lambda scheme, k: F.concat(F.lit(f"{scheme}//h"), text(k), F.lit(".example/f"))
    later = (i * 3 + 1) % n
    location = F.when(i % 11 == 0, F.lit(None)).when(i % 7 == 0, address("", later)).when(i % 13 == 0, address("http:", (i + 5) % n)).when(i % 17 == 0, F.concat(F.lit("https://10.0.0."), text(i % 250), F.lit("/f"))).otherwise(address("https:", later))
    own = p.select("i", address("https:", i).alias("url"), location.alias("location"), (i % 2 == 0).alias("public_only"))
    return redirects.followed(own, own, "i").withColumnRenamed("i", "page_id")


def box(kind: str, body: Column, size: Column | None = None) -> Column:
    """A box in hex, of a body in hex; its length may be said wrongly."""
    n = F.octet_length(F.unhex(body)).cast("long") + 8 if size is None else size
    return F.concat(F.lpad(F.hex(n), 8, "0"), F.lit(kind.encode().hex().upper()), body)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, content (hex): pages as files of boxes; the html is the media, of some the boxes' order or lengths are wrong."""
    i, html = F.col("page_id"), F.hex(F.coalesce("html", F.lit("")).cast("binary"))
    p = read(spark, sf_dir, "pages", "page_id", "html").dropDuplicates(["page_id"]).select("page_id", html.alias("h"))
    h, none = F.col("h"), F.lit("")
    long = F.concat(F.lit("00000001" + b"mdat".hex().upper()), F.lpad(F.hex(F.octet_length(F.unhex(h)).cast("long") + 16), 16, "0"), h)
    kinds = [
        F.concat(box("ftyp", F.lit("69736F6D")), box("moov", h), box("mdat", h)), F.concat(box("styp", none), box("moof", F.lit("0011")), long), F.concat(box("mdat", h), box("moof", none)),
        F.concat(box("free", h), box("ftyp", none), box("moov", h)), F.concat(box("ftyp", none), box("moov", h, F.lit(1 << 20))), F.concat(box("moov", h), box("ftyp", none)),
        F.concat(box("ftyp", none), box("mdat", h, F.lit(0)), F.lit("0102")), F.concat(box("ftyp", none), box("moof", h), F.lit("000000")), F.concat(box("ftyp", none), box("free", none, F.lit(7)), h), F.concat(box("ftyp", none), F.lit("0000001C00010203"), h),
    ]
    return p.select("page_id", F.element_at(F.array(*kinds), (i % 10 + 1).cast("int")).alias("x"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those files in chunks of 3 to 259 bytes."""
    files = page_files(spark, sf_dir).select("page_id", F.unhex("x").alias("x"), (F.col("page_id") % 257 + 3).cast("int").alias("n"))
    parts = F.sequence(F.lit(0), N.idiv(F.octet_length("x") + F.col("n") - 1, F.col("n")).cast("int") - 1)
    cut = B.written(files).select("page_id", "x", "n", F.explode(parts).alias("i"))
    return B.written(cut.select("page_id", "i", F.substring("x", F.col("i") * F.col("n") + 1, F.col("n")).alias("content")))


_PAGES_SQL = "SELECT page_id, page_id % 10 AS k, octet_length(encode(coalesce(html, ''))) AS n FROM (SELECT page_id, any_value(html) AS html FROM pages GROUP BY page_id)"


@query(f"""WITH p AS ({_PAGES_SQL}), w AS (SELECT page_id, k, n, CASE k
    WHEN 0 THEN [{{'at': 0, 'header': 8, 'size': 12, 'kind': 'ftyp'}}, {{'at': 12, 'header': 8, 'size': n + 8, 'kind': 'moov'}}, {{'at': 20 + n, 'header': 8, 'size': n + 8, 'kind': 'mdat'}}]
    WHEN 1 THEN [{{'at': 0, 'header': 8, 'size': 8, 'kind': 'styp'}}, {{'at': 8, 'header': 8, 'size': 10, 'kind': 'moof'}}, {{'at': 18, 'header': 16, 'size': n + 16, 'kind': 'mdat'}}]
    WHEN 2 THEN [{{'at': 0, 'header': 8, 'size': n + 8, 'kind': 'mdat'}}, {{'at': n + 8, 'header': 8, 'size': 8, 'kind': 'moof'}}]
    WHEN 3 THEN [{{'at': 0, 'header': 8, 'size': n + 8, 'kind': 'free'}}, {{'at': n + 8, 'header': 8, 'size': 8, 'kind': 'ftyp'}}, {{'at': n + 16, 'header': 8, 'size': n + 8, 'kind': 'moov'}}]
    WHEN 4 THEN [{{'at': 0, 'header': 8, 'size': 8, 'kind': 'ftyp'}}, {{'at': 8, 'header': 8, 'size': NULL, 'kind': 'moov'}}]
    WHEN 5 THEN [{{'at': 0, 'header': 8, 'size': n + 8, 'kind': 'moov'}}, {{'at': n + 8, 'header': 8, 'size': 8, 'kind': 'ftyp'}}]
    WHEN 6 THEN [{{'at': 0, 'header': 8, 'size': 8, 'kind': 'ftyp'}}, {{'at': 8, 'header': 8, 'size': n + 10, 'kind': 'mdat'}}]
    WHEN 7 THEN [{{'at': 0, 'header': 8, 'size': 8, 'kind': 'ftyp'}}, {{'at': 8, 'header': 8, 'size': n + 8, 'kind': 'moof'}}, {{'at': n + 16, 'header': NULL, 'size': NULL, 'kind': NULL}}]
    ELSE [{{'at': 0, 'header': 8, 'size': 8, 'kind': 'ftyp'}}, {{'at': 8, 'header': NULL, 'size': NULL, 'kind': NULL}}] END AS x FROM p)
SELECT page_id, (b->>'at')::BIGINT AS at, (b->>'header')::BIGINT AS header, (b->>'size')::BIGINT AS size, b->>'kind' AS kind FROM (SELECT page_id, unnest(x)::JSON AS b FROM w)""")
def chunked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.boxes(page_chunks(spark, sf_dir), "page_id", ["i"]).select("page_id", "at", "header", "size", "kind")


@query(f"""WITH p AS ({_PAGES_SQL}) SELECT page_id, CASE k WHEN 0 THEN 'progressive' WHEN 3 THEN 'progressive' WHEN 4 THEN 'pending' WHEN 7 THEN 'pending' ELSE 'artifact' END AS decision,
  CASE WHEN k IN (4, 7, 8, 9) THEN 'DECODE_ERROR' WHEN k IN (1, 2, 6) THEN 'INVALID_SOURCE' END AS init_error, CASE WHEN k IN (4, 7, 8, 9) THEN 'DECODE_ERROR' WHEN k <> 1 THEN 'INVALID_SOURCE' END AS fragment_error FROM p""")
def box_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the boxes of those files allow: a fast start, an initialization, a fragment."""
    found = B.written(B.boxes(page_chunks(spark, sf_dir), "page_id", ["i"]))
    return B.fast_starts(found, "page_id").join(B.fragments(found, "page_id"), "page_id").select("page_id", "decision", "init_error", "fragment_error")


@query("""WITH p AS (SELECT page_id, page_id % 6 AS k, coalesce(html, '') AS html FROM (SELECT page_id, any_value(html) AS html FROM pages GROUP BY page_id))
SELECT page_id, CASE k WHEN 0 THEN 'fmp4' WHEN 2 THEN 'aac' WHEN 4 THEN 'mpeg' END AS kind, CASE WHEN k IN (2, 4, 5) THEN md5(CASE k WHEN 2 THEN unhex('FFF1') WHEN 4 THEN unhex('FFFB') ELSE ''::BLOB END || encode(html)) END AS digest,
  CASE k WHEN 1 THEN 'INVALID_SOURCE' WHEN 3 THEN 'UNSUPPORTED' END AS error FROM p""")
def segment_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as segments: fragments in either order, transport streams, bare fragments, elementary streams, and text."""
    i, h = F.col("page_id") % 6, F.hex(F.coalesce("html", F.lit("")).cast("binary"))
    p = read(spark, sf_dir, "pages", "page_id", "html").dropDuplicates(["page_id"]).select("page_id", i.alias("i"), h.alias("h"))
    i, h = F.col("i"), F.col("h")
    fragment, swapped = F.concat(box("styp", F.lit("")), box("moof", F.lit("")), box("mdat", h)), F.concat(box("mdat", h), box("moof", F.lit("")))
    plain = F.when(i == 0, fragment).when(i == 1, swapped).when(i == 3, box("moof", h)).when(i == 4, F.concat(F.lit("FFFB"), h)).otherwise(h)
    body = F.when(i == 2, transport(F.concat(F.lit("FFF1"), h), F.lit(False))).otherwise(F.unhex(plain))
    own = p.select("page_id", F.when(i == 2, "https://h.example/a.ts").otherwise("https://h.example/a").alias("url"), (i < 2).alias("mapped"), body.alias("content"))
    out = B.normalized(own, "page_id")
    return out.select("page_id", "kind", F.when(F.col("kind").isNull() | (F.col("kind") != "fmp4"), F.md5("audio")).alias("digest"), "error")


_MARKS = """SELECT user_id, event_id, event_id * 20 + event_id % 13 AS t, CASE WHEN event_id % 37 = 0 THEN 'request' ELSE ['admitted', 'opened', 'probed', 'prebuffered', 'sent'][event_id % 5 + 1] END AS mark FROM events"""
_STAGES = f"""WITH m AS ({_MARKS}), r AS (SELECT user_id, event_id, t, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM m WHERE mark = 'request'),
a AS (SELECT r.*, (SELECT min(m.t) FROM m WHERE m.user_id = r.user_id AND m.event_id > r.event_id AND (until IS NULL OR m.event_id < until) AND mark = 'admitted' AND m.t >= r.t) AS t1 FROM r),
b AS (SELECT a.*, (SELECT min(m.t) FROM m WHERE m.user_id = a.user_id AND m.event_id > a.event_id AND (until IS NULL OR m.event_id < until) AND mark = 'opened' AND m.t >= t1) AS t2 FROM a),
c AS (SELECT b.*, (SELECT min(m.t) FROM m WHERE m.user_id = b.user_id AND m.event_id > b.event_id AND (until IS NULL OR m.event_id < until) AND mark = 'probed' AND m.t >= t2) AS t3 FROM b),
d AS (SELECT c.*, (SELECT min(m.t) FROM m WHERE m.user_id = c.user_id AND m.event_id > c.event_id AND (until IS NULL OR m.event_id < until) AND mark = 'prebuffered' AND m.t >= t3) AS t4 FROM c),
e AS (SELECT d.*, (SELECT min(m.t) FROM m WHERE m.user_id = d.user_id AND m.event_id > d.event_id AND (until IS NULL OR m.event_id < until) AND mark = 'sent' AND m.t >= t4) AS t5 FROM d),
f AS (SELECT user_id, event_id, t1 - t AS admission_ms, t2 - t1 AS open_ms, t3 - t2 AS probe_ms, t4 - t3 AS prebuffer_ms, t5 - t4 AS send_ms, t5 - t AS total_ms FROM e)"""


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    mark = F.when(i % 37 == 0, stages.REQUEST).otherwise(F.element_at(F.array(*[F.lit(x) for x in stages.STAGES.values()]), (i % 5 + 1).cast("int")))
    e = read(spark, sf_dir, "events", "user_id", "event_id").select("user_id", "event_id", (i * 20 + i % 13).alias("at"), mark.alias("mark"))
    return stages.first_packets(e, "user_id", ["event_id"], "at", "mark")


@query(f"{_STAGES} SELECT * FROM f")
def first_packet_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir).drop("at", "mark")


@query(f"""{_STAGES}, s AS (UNPIVOT (SELECT ['file', 'url', 'live'][user_id % 3 + 1] AS source, CASE event_id % 2 WHEN 0 THEN 'current' ELSE 'next' END AS role, admission_ms, open_ms, probe_ms, prebuffer_ms, send_ms, total_ms FROM f) ON admission_ms, open_ms, probe_ms, prebuffer_ms, send_ms, total_ms INTO NAME stage VALUE ms),
k AS (SELECT source, role, replace(stage, '_ms', '') AS stage, row_number() OVER w AS place, count(*) OVER (PARTITION BY source, role, stage) AS n, CASE WHEN ms > 0 THEN pow({stages.GROWTH}::DOUBLE, ceil(ln(ms) / {math.log(stages.GROWTH)}::DOUBLE)) * {2 / (stages.GROWTH + 1)}::DOUBLE ELSE 0 END AS v FROM s WHERE ms IS NOT NULL WINDOW w AS (PARTITION BY source, role, stage ORDER BY ms))
SELECT source, role, stage, max(n) AS count, round(max(CASE WHEN place = ceil(n * 0.5::DOUBLE) THEN v END), 6) AS p50, round(max(CASE WHEN place = ceil(n * 0.95::DOUBLE) THEN v END), 6) AS p95 FROM k GROUP BY ALL""")
def first_packet_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of a thousand events each, added up by source and role."""
    own = _stages(spark, sf_dir)
    source, role = F.element_at(F.array(F.lit("file"), F.lit("url"), F.lit("live")), (F.col("user_id") % 3 + 1).cast("int")), F.when(F.col("event_id") % 2 == 0, "current").otherwise("next")
    names = [*stages.STAGES, "total"]
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("stage"), F.col(f"{x}_ms").alias("ms")) for x in names]))
    rows = own.select(source.alias("source"), role.alias("role"), N.idiv(F.col("event_id"), 1000).alias("part"), each.alias("x")).select("source", "role", "part", "x.*")
    parts = stages.sketch(rows, ["part", "source", "role", "stage"], "ms")
    out = stages.quantiles(stages.merged(parts, ["source", "role", "stage"]), ["source", "role", "stage"], {"p50": 0.5, "p95": 0.95})
    return out.select("source", "role", "stage", "count", N.rounded(F.col("p50"), 6).alias("p50"), N.rounded(F.col("p95"), 6).alias("p95"))

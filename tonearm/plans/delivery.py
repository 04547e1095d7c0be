"""Queries over playlists, slots, retries and hand-over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery as D
from ..operators import playlists as P
from ..operators import streams as S
from .catalogue import query, read

_SEGMENT_SQL = """SELECT l_orderkey AS playlist, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS idx,
  l_partkey, l_suppkey, l_quantity::BIGINT AS quantity FROM lineitem"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order in order, with their numbers."""
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    own = S.dealt(read(spark, sf_dir, "lineitem", "l_orderkey", *order), "l_orderkey")
    return own.select(F.col("l_orderkey").alias("playlist"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("idx"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("quantity"))


@query(f"""WITH s AS ({_SEGMENT_SQL})
SELECT playlist, idx, 'seg/' || l_partkey || '.ts' AS uri, quantity::DOUBLE AS seconds, playlist % 1000 + idx - 1 AS sequence, l_suppkey % 5 = 0 AS discontinuity, l_suppkey % 4 = 0 AS gap,
  CASE WHEN l_partkey % 3 = 0 THEN quantity END AS range_len, CASE WHEN l_partkey % 6 = 0 THEN l_suppkey END AS range_off,
  last_value(CASE WHEN l_partkey % 7 = 0 THEN 'k' || l_suppkey END IGNORE NULLS) OVER (PARTITION BY playlist ORDER BY idx ROWS UNBOUNDED PRECEDING) AS key_uri, playlist % 2 = 0 AS end_list, 10::BIGINT AS target_seconds FROM s""")
def playlist_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as the text of a playlist, read back."""
    part, supp, text = F.col("l_partkey"), F.col("l_suppkey"), lambda c: F.col(c).cast("string")
    line = lambda c, *x: F.when(c, F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("\n"))).otherwise("")
    span = line(part % 3 == 0, "#EXT-X-BYTERANGE:", text("quantity"), F.when(part % 6 == 0, F.concat(F.lit("@"), text("l_suppkey"))).otherwise(""))
    segment = F.concat(
        line(part % 7 == 0, '#EXT-X-KEY:METHOD=AES-128,URI="k', text("l_suppkey"), '",IV=0x1'), line(supp % 5 == 0, "#EXT-X-DISCONTINUITY"), line(supp % 4 == 0, "#EXT-X-GAP"),
        line(F.lit(True), "#EXTINF:", text("quantity"), ",a, title"), span, line(F.lit(True), "seg/", text("l_partkey"), ".ts"),
    )
    s = _segments(spark, sf_dir).select("playlist", "idx", segment.alias("x"))
    body = s.groupBy("playlist").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda v: v["x"]), "").alias("body"))
    head = F.concat(F.lit("#EXTM3U\r\n#EXT-X-TARGETDURATION:10\n#EXT-X-MEDIA-SEQUENCE:"), (F.col("playlist") % 1000).cast("string"), F.lit("\n\n"))
    made = P.media_segments(body.select("playlist", F.concat(head, "body", F.when(F.col("playlist") % 2 == 0, "#EXT-X-ENDLIST\n").otherwise("")).alias("text")), "playlist")
    return made.select("playlist", "idx", "uri", "seconds", "sequence", "discontinuity", "gap", "range_len", "range_off", P.attribute(F.col("key_tag"), "URI").alias("key_uri"), "end_list", "target_seconds")


@query("""WITH p AS (SELECT page_id AS id, (5 - page_id % 5) % 5 AS masters FROM pages), h AS (SELECT p.*, (SELECT count(*) FROM pages q WHERE q.page_id BETWEEN p.id AND p.id + p.masters) = masters + 1 AS whole,
  (SELECT min(g) FROM range(1, 6) r(g) WHERE id + g NOT IN (SELECT page_id FROM pages)) AS hole FROM p)
SELECT id, CASE WHEN masters <= 2 AND whole THEN 'https://media.example/lists/' || (id + masters) || '.m3u8' END AS url, least(masters + 1, 3, CASE WHEN whole THEN 9 ELSE hole + 1 END)::INTEGER AS depth,
  CASE WHEN masters > 2 OR NOT whole THEN 'INVALID_SOURCE' END AS error FROM h""")
def playlist_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a playlist; four of five lead on to the next, by a relative address."""
    id_ = F.col("page_id")
    url = F.concat(F.lit("https://media.example/lists/"), id_.cast("string"), F.lit(".m3u8"))
    further = F.concat(F.lit("./x/../"), (id_ + 1).cast("string"), F.lit(".m3u8\n"))
    master = F.concat(
        F.lit('#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=96000,CODECS="ec-3"\nno.m3u8\n#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=1,URI="no.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH=128000,CODECS="mp4a.40.2"\n'), further,
        F.lit('#EXT-X-STREAM-INF:BANDWIDTH=64000,RESOLUTION=1x1,CODECS="mp4a.40.2"\nno.m3u8\n'),
    )
    media = F.lit("#EXTM3U\n#EXTINF:4,\na.ts\n")
    own = read(spark, sf_dir, "pages", "page_id").distinct().select(id_.alias("id"), url.alias("url"), F.when(id_ % 5 != 0, master).otherwise(media).alias("text"))
    return P.resolve(own.select("id", "url"), own.select("url", "text"))


@query(f"""WITH s AS (SELECT *, CASE WHEN playlist % 3 = 0 THEN 'm' || (l_partkey % 40 = 0) WHEN playlist % 11 = 0 AND idx > 2 THEN 'm' END AS map, CASE WHEN l_suppkey % 9 > 0 THEN CASE WHEN l_suppkey % 25 = 0 THEN 'mpeg' ELSE 'aac' END END AS kind, l_suppkey % 4 = 0 AS gap FROM ({_SEGMENT_SQL})),
f AS (SELECT *, arg_min(map, idx) FILTER (map IS NOT NULL) OVER w AS any_map, first_value(map) OVER (PARTITION BY playlist ORDER BY idx) AS map0, first_value(kind IGNORE NULLS) OVER (PARTITION BY playlist ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kind0 FROM s WHERE NOT gap WINDOW w AS (PARTITION BY playlist)),
b AS (SELECT playlist, min(idx) FILTER (map IS DISTINCT FROM map0 OR kind <> kind0) AS stopped_at FROM f GROUP BY playlist)
SELECT s.playlist, count(*) FILTER (NOT gap AND (stopped_at IS NULL OR idx < stopped_at)) AS delivered, count(*) FILTER (gap) AS gaps, any_value(stopped_at) AS stopped_at, CASE WHEN any_value(stopped_at) IS NOT NULL THEN 'UNSUPPORTED' END AS error
FROM s LEFT JOIN b ON b.playlist = s.playlist GROUP BY s.playlist""")
def segment_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("playlist"), F.col("l_suppkey")
    map_ = F.when(p % 3 == 0, F.concat(F.lit("m"), (F.col("l_partkey") % 40 == 0).cast("string"))).when((p % 11 == 0) & (F.col("idx") > 2), "m")
    kind = F.when(s % 9 > 0, F.when(s % 25 == 0, "mpeg").otherwise("aac"))
    return P.delivery(_segments(spark, sf_dir).select("playlist", "idx", map_.alias("map"), kind.alias("kind"), (s % 4 == 0).alias("gap")), "playlist", ["idx"])



_LOG_SQL = """SELECT user_id, event_id, ts, event_id % 3 + 1 AS claim, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'take' WHEN 'purchase' THEN 'pause' ELSE 'resume' END AS kind, event_id % 2 = 0 AS initial,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "signup", "put").when(t == "error", "take").when(t == "purchase", "pause").otherwise("resume")
    return read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type").select("user_id", "event_id", "ts", (i % 3 + 1).alias("claim"), kind.alias("kind"), (i % 2 == 0).alias("initial"))


@query(f"""WITH RECURSIVE e AS ({_LOG_SQL}), s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS generation, NULL::BIGINT AS stopped, false AS effective, false AS paused FROM (SELECT DISTINCT user_id FROM e) UNION ALL
SELECT e.user_id, e.n, e.event_id, CASE WHEN kind = 'put' THEN claim WHEN kind = 'take' AND s.generation = claim THEN NULL ELSE s.generation END, CASE WHEN kind = 'put' OR kind = 'take' AND s.generation = claim THEN s.generation END,
  kind = 'put' OR coalesce(s.generation = claim, false), CASE WHEN kind = 'put' THEN initial WHEN s.generation = claim AND kind = 'pause' THEN true WHEN s.generation = claim AND kind = 'resume' THEN false ELSE s.paused END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, generation, stopped, effective, paused FROM s WHERE n > 0""")
def output_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.generation_slot(_log(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "generation", "stopped", "effective", "paused")


@query("""WITH a AS (SELECT o_orderkey AS request, n, (o_orderkey + n * 7) % 5 = 0 AS ok, (o_orderkey + n) % 4 <> 0 AS retryable, (o_orderkey * 3 + n) % 11 = 0 AS published, 'E' || n AS code, o_custkey % 4 AS most FROM orders, range(0, 5) r(n)),
s AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY n) AS place FROM a WHERE ok OR NOT retryable OR published OR n >= most)
SELECT request, n + 1 AS tries, ok, CASE WHEN NOT ok THEN code END AS code FROM s WHERE place = 1""")
def download_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    n = F.col("n")
    a = o.select(k.alias("request"), "n", ((k + n * 7) % 5 == 0).alias("ok"), ((k + n) % 4 != 0).alias("retryable"), ((k * 3 + n) % 11 == 0).alias("published"), F.concat(F.lit("E"), n.cast("string")).alias("code"), (F.col("o_custkey") % 4).alias("most"))
    return D.retried(a, "request", F.col("most"))


@query("""WITH e AS (SELECT user_id % 97 AS spool, event_id, CASE event_id % 9 WHEN 0 THEN 'finish' WHEN 1 THEN 'fail' WHEN 2 THEN 'drop' ELSE 'write' END AS kind FROM events)
SELECT spool, CASE WHEN count(*) FILTER (kind <> 'write') = 0 THEN 'open' WHEN arg_min(kind, event_id) FILTER (kind <> 'write') = 'finish' THEN 'complete' ELSE 'failed' END AS state FROM e GROUP BY spool""")
def spool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 9
    kind = F.when(i == 0, "finish").when(i == 1, "fail").when(i == 2, "drop").otherwise("write")
    e = read(spark, sf_dir, "events", "user_id", "event_id").select((F.col("user_id") % 97).alias("spool"), "event_id", kind.alias("kind"))
    return D.first_terminal(e, "spool", ["event_id"])


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS p FROM events), f AS (SELECT user_id, min(event_id) AS first FROM e WHERE p GROUP BY user_id)
SELECT e.user_id, e.event_id, CASE WHEN e.event_id >= first THEN 'current' ELSE 'next' END AS role, coalesce(e.event_id = first, false) AS released FROM e LEFT JOIN f ON f.user_id = e.user_id""")
def producer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "promote").otherwise("work").alias("kind"))
    return D.promotions(e, "user_id", ["event_id"]).select("user_id", "event_id", "role", "released")


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'quality' WHEN 'click' THEN 'prebuffer' WHEN 'error' THEN 'terminal' WHEN 'signup' THEN 'quality' END AS slot,
  count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS batch FROM events),
l AS (SELECT user_id, batch, slot, max(event_id) AS event_id FROM e WHERE slot IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY CASE slot WHEN 'prebuffer' THEN 1 WHEN 'terminal' THEN 2 ELSE 3 END)::INTEGER AS place FROM l""")
def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    slot = F.when(t == "click", "prebuffer").when(t == "error", "terminal").otherwise("quality")
    return D.pending_slots(read(spark, sf_dir, "events", "user_id", "event_id", "event_type"), "user_id", ["event_id"], slot, t == "purchase").select("user_id", "batch", "slot", "event_id", "place")


@query("""WITH e AS (SELECT user_id, event_id, event_id * 20 AS t, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'pause' WHEN 'view' THEN 'ready' ELSE 'other' END AS kind FROM events)
SELECT user_id, event_id, t + 3000 AS due FROM e WHERE kind = 'start' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.kind <> 'other' AND x.t > e.t AND x.t <= e.t + 3000)""")
def startup_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "signup", "start").when(t == "purchase", "pause").when(t == "view", "ready").otherwise("other")
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select("user_id", "event_id", (F.col("event_id") * 20).alias("at"), kind.alias("kind"))
    return D.startup_deadlines(e, "user_id", ["event_id"], "at", 3000).select("user_id", "event_id", "due")


@query("""WITH c AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size FROM pages)
SELECT page_id, piece, piece * 700 AS at, least(700, size - piece * 700) AS length FROM (SELECT page_id, size, unnest(range(0, (size + 699) // 700)) AS piece FROM c)""")
def byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    return D.split_bytes(p, "size", 700).select("page_id", "piece", "at", "length")


@query("""SELECT event_id, user_id AS lease_id, greatest(event_id * 7919 % 1000 - 300, 0) AS remaining_ns, least(9223372036854775000::HUGEINT + greatest(event_id * 7919 % 1000 - 300, 0), 9223372036854775807)::BIGINT AS deadline_ns,
  user_id * 1000 + event_id * 20 AS position_ms, event_id % 7 AS packets_sent, event_id % 7 * 200 AS bytes_sent, 0 AS sequence, 0::BIGINT AS rtp_timestamp, NULL::VARCHAR AS report FROM events""")
def pull_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    frame = D.frame_handover(u, i * 7919 % 1000 + 1000, F.lit(1300).cast("long"), F.lit(9_223_372_036_854_775_000))
    return read(spark, sf_dir, "events", "event_id", "user_id").select("event_id", frame.alias("f"), D.pull_progress(u * 1000, i * 20, i % 7, i % 7 * 200).alias("p")).select("event_id", "f.*", "p.*")


@query("""SELECT event_id AS sequence, k AS type, 's' || user_id AS stream_id, CASE WHEN k = 'stateChanged' THEN 'playing' END AS status, CASE WHEN k IN ('sourceRefreshNeeded', 'attemptFailed') THEN 'a' || event_id END AS attempt_id,
  CASE WHEN k IN ('sourceRefreshNeeded', 'attemptFailed') THEN 't' || event_id % 9 END AS track_id, CASE WHEN k IN ('sourceRefreshNeeded', 'attemptFailed') THEN 'next' END AS source_role, CASE WHEN k IN ('sourceRefreshNeeded', 'attemptFailed') THEN event_id % 5 END AS generation,
  CASE WHEN k = 'networkQualityChanged' THEN 'poor' END AS quality, CASE WHEN k = 'networkQualityChanged' THEN event_id * 13 % 1000 / 1000.0::DOUBLE END AS jitter_ms, CASE WHEN k IN ('attemptFailed', 'error') THEN 'BUSY' END AS code, CASE WHEN k IN ('attemptFailed', 'error') THEN 'm' || event_id END AS message
FROM (SELECT *, CASE event_id % 8 WHEN 0 THEN 'streamStarted' WHEN 1 THEN 'streamStopped' WHEN 2 THEN 'stateChanged' WHEN 3 THEN 'nextNeeded' WHEN 4 THEN 'sourceRefreshNeeded' WHEN 5 THEN 'networkQualityChanged' WHEN 6 THEN 'attemptFailed' ELSE 'error' END AS k FROM events)""")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    names = ("streamStarted", "streamStopped", "stateChanged", "nextNeeded", "sourceRefreshNeeded", "networkQualityChanged", "attemptFailed", "error")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = read(spark, sf_dir, "events", "event_id", "user_id").select(
        i.alias("sequence"), F.element_at(F.array(*[F.lit(x) for x in names]), (i % 8 + 1).cast("int")).alias("kind"), text("s", F.col("user_id")).alias("stream_id"), F.lit("playing").alias("status"), text("a", i).alias("attempt_id"),
        text("t", i % 9).alias("track_id"), F.lit("next").alias("source_role"), (i % 5).alias("generation"), F.lit("poor").alias("quality"), (i * 13 % 1000 / 1000.0).alias("jitter_ms"), F.lit("BUSY").alias("code"), text("m", i).alias("message"),
    )
    return D.event_rows(e)


@query("""SELECT run, p_partkey, allocations, bytes FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY allocations, bytes) AS place, count(*) OVER (PARTITION BY run) AS n
  FROM (SELECT p_partkey // 7 AS run, p_partkey, p_size::BIGINT AS allocations, p_partkey * 7919 % 1000 AS bytes FROM part)) WHERE n = 7 AND place = 4""")
def median_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numbers import idiv

    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part", "p_partkey", "p_size").select(idiv(k, 7).alias("run"), "p_partkey", F.col("p_size").cast("long").alias("allocations"), (k * 7919 % 1000).alias("bytes"))
    return D.median_of(p, "run", ["allocations", "bytes"])


@query("""WITH f AS (SELECT o_custkey % 40 AS host, 'stream' || o_orderkey || ': ' || o_orderstatus AS failure, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey % 40) AS n FROM orders)
SELECT host, any_value(n) || ' stream shutdown operation(s) failed: ' || string_agg(failure, '; ' ORDER BY place) FILTER (place <= 8) || CASE WHEN any_value(n) > 8 THEN '; ' || (any_value(n) - 8) || ' additional failures omitted' ELSE '' END AS message FROM f GROUP BY host""")
def shutdown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    failure = F.concat(F.lit("stream"), F.col("o_orderkey").cast("string"), F.lit(": "), "o_orderstatus")
    return D.failure_summary(o.select((F.col("o_custkey") % 40).alias("host"), "o_orderkey", failure.alias("failure")), "host", ["o_orderkey"], "failure")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'wait' WHEN 'signup' THEN 'end' ELSE 'chunk' END AS kind, 7 + event_id % 30 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 1::BIGINT AS turn, 0::BIGINT AS decoded, 0::BIGINT AS total, 0::BIGINT AS decoded_ms, NULL::VARCHAR AS closed, 1::BIGINT AS turn_out FROM (SELECT DISTINCT user_id FROM e) UNION ALL
SELECT e.user_id, e.n, e.event_id, s.turn + (c.closed IS NOT NULL)::BIGINT, CASE WHEN c.closed IS NULL THEN d.x ELSE 0 END, s.total + d.ms, d.x, c.closed, s.turn FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1,
  LATERAL (SELECT CASE kind WHEN 'chunk' THEN e.ms ELSE 0 END AS ms, s.decoded + CASE kind WHEN 'chunk' THEN e.ms ELSE 0 END AS x) d,
  LATERAL (SELECT CASE WHEN kind = 'chunk' AND d.x >= 80 THEN 'batch' WHEN kind = 'wait' THEN 'need_more' WHEN kind = 'end' THEN CASE WHEN s.total > 0 THEN 'ended' ELSE 'DECODE_ERROR' END END AS closed) c)
SELECT user_id, event_id, turn_out AS turn, decoded_ms, closed FROM s WHERE n > 0""")
def decode_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import folds

    t = F.col("event_type")
    kind = F.when(t == "error", "wait").when(t == "signup", "end").otherwise("chunk")
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select("user_id", "event_id", kind.alias("kind"), (F.col("event_id") % 30 + 7).alias("ms"))
    return folds.fold(e, "user_id", ["event_id"], folds.turn_step, folds.turn_start, folds.TURNS)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id * 7 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 2 + 1 AS rg, event_id % 9 * 100 AS rs, event_id % 4 = 0 AS rp, event_id % 3 + 1 AS rl,
  CASE WHEN event_id % 5 = 0 THEN 'late' WHEN event_id % 31 = 0 THEN 'outputUnavailable' WHEN event_id % 13 = 0 THEN 'cancelled' ELSE 'sent' END AS outcome,
  CASE event_type WHEN 'signup' THEN 'activate' WHEN 'purchase' THEN CASE event_id % 7 WHEN 0 THEN 'close' WHEN 1 THEN 'pause' WHEN 2 THEN 'resume' WHEN 3 THEN 'deactivate' ELSE 'frame' END WHEN 'error' THEN 'ack' WHEN 'click' THEN 'pull' ELSE 'frame' END AS k FROM events),
s AS (SELECT user_id, 1::BIGINT AS n, 0 AS ph, NULL::BIGINT AS g, 0::BIGINT AS st, 0::BIGINT AS q, false AS closed, false AS started, false AS told, NULL::BIGINT AS due, 0::BIGINT AS sent, false AS paused, false AS waiting, NULL::BIGINT AS lid, NULL::BIGINT AS lg, 0::BIGINT AS lat, false AS lret,
  1::BIGINT AS nxt, 0::BIGINT AS delivered, 0::BIGINT AS dropped, NULL::VARCHAR AS o_kind, 0::BIGINT AS o_at, NULL::BIGINT AS o_lease, NULL::BIGINT AS o_g, NULL::BIGINT AS o_pos, NULL::BIGINT AS o_late, NULL::VARCHAR AS o_code FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT s.user_id, s.n + (act = 'next')::BIGINT, CASE WHEN act IN ('expire') OR act = 'serve' AND s.ph = 0 THEN 0 WHEN act = 'apply' THEN CASE WHEN k = 'ack' AND mine AND outcome = 'outputUnavailable' THEN 1 ELSE 2 END WHEN act = 'acked' THEN 2 WHEN act = 'start' THEN 3 ELSE CASE WHEN s.ph = 3 AND act <> 'next' THEN 4 ELSE 0 END END,
  CASE WHEN act = 'expire' OR act = 'serve' AND ends THEN NULL WHEN act = 'apply' THEN CASE WHEN k = 'activate' THEN rg WHEN k = 'deactivate' AND own OR k = 'ack' AND mine AND outcome = 'outputUnavailable' AND NOT s.lret THEN NULL ELSE s.g END ELSE s.g END,
  CASE WHEN act = 'apply' AND k = 'activate' THEN rs ELSE s.st END, CASE WHEN act = 'apply' THEN CASE WHEN k = 'activate' THEN 0 WHEN k = 'frame' AND s.g IS NOT NULL THEN s.q + 1 ELSE s.q END WHEN act = 'serve' AND s.q > 0 THEN s.q - drops - 1 ELSE s.q END,
  CASE WHEN act = 'apply' THEN CASE WHEN k = 'activate' THEN false WHEN k = 'close' AND s.g IS NOT NULL THEN true ELSE s.closed END ELSE s.closed END,
  CASE WHEN act = 'apply' AND k = 'activate' THEN false WHEN act = 'start' AND begins THEN true WHEN act = 'serve' AND NOT ends AND s.q = 0 THEN false ELSE s.started END, CASE WHEN act = 'apply' AND k = 'activate' THEN false WHEN act = 'start' AND begins THEN true ELSE s.told END,
  CASE WHEN act = 'apply' THEN CASE WHEN k = 'activate' THEN NULL WHEN k = 'resume' AND own THEN e.t WHEN counts THEN CASE WHEN e.t - s.lat > 20 OR coalesce(s.due, e.t) + 20 > e.t THEN coalesce(s.due, e.t) + 20 ELSE e.t + 20 END ELSE s.due END
    WHEN act = 'start' AND begins THEN e.t WHEN act = 'serve' THEN CASE WHEN s.q = 0 THEN NULL ELSE s.due + drops * 20 END ELSE s.due END,
  CASE WHEN act = 'apply' THEN CASE WHEN k = 'activate' THEN 0 WHEN counts THEN s.sent + 20 ELSE s.sent END WHEN act = 'serve' AND s.q > 0 THEN s.sent + drops * 20 ELSE s.sent END,
  CASE WHEN act = 'apply' THEN CASE WHEN k = 'activate' THEN rp WHEN k = 'pause' AND own THEN true WHEN k = 'resume' AND own THEN false ELSE s.paused END ELSE s.paused END,
  CASE WHEN act = 'expire' THEN false WHEN act = 'apply' AND k = 'pull' AND NOT busy THEN true WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN false ELSE s.waiting END,
  CASE WHEN act = 'expire' OR act = 'apply' AND k = 'ack' AND mine AND outcome <> 'outputUnavailable' OR act = 'acked' THEN NULL WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN s.nxt ELSE s.lid END, CASE WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN s.g ELSE s.lg END,
  CASE WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN now ELSE s.lat END, CASE WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN false WHEN act = 'apply' AND (k = 'activate' OR k = 'deactivate' AND own) THEN true ELSE s.lret END,
  CASE WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN s.nxt + 1 ELSE s.nxt END, s.delivered + (act = 'apply' AND coalesce(tells, false) AND outcome = 'sent')::BIGINT, s.dropped + (act = 'apply' AND coalesce(tells, false) AND outcome = 'late')::BIGINT + CASE WHEN act = 'serve' AND s.q > 0 THEN drops ELSE 0 END,
  CASE act WHEN 'expire' THEN 'failed' WHEN 'acked' THEN 'ack' WHEN 'start' THEN CASE WHEN begins AND NOT s.told THEN 'prebuffer_ready' END WHEN 'serve' THEN CASE WHEN ends THEN 'ended' WHEN s.q = 0 THEN 'underrun' ELSE 'frame' END
    WHEN 'apply' THEN CASE WHEN k = 'ack' THEN CASE WHEN mine AND outcome = 'outputUnavailable' THEN 'failed' ELSE 'ack' END WHEN k = 'pull' AND busy THEN 'pull' END END, CASE WHEN act = 'expire' THEN s.lat + 2000 ELSE now END,
  CASE WHEN act IN ('expire', 'acked') THEN s.lid WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN s.nxt WHEN act = 'apply' AND k = 'ack' THEN CASE WHEN mine THEN CASE WHEN outcome <> 'outputUnavailable' THEN s.lid END ELSE rl END END,
  CASE WHEN act IN ('expire', 'acked') OR act = 'apply' AND k = 'ack' AND mine THEN s.lg ELSE s.g END, CASE WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN s.st + s.sent + drops * 20 + 20 END, CASE WHEN act = 'serve' AND NOT ends AND s.q > 0 THEN now - s.due - drops * 20 END,
  CASE WHEN act = 'expire' OR act = 'apply' AND k = 'ack' AND mine AND outcome = 'outputUnavailable' THEN 'OUTPUT_ERROR' WHEN act = 'apply' AND k = 'ack' AND NOT mine THEN 'INVALID_CONFIG' WHEN act = 'apply' AND k = 'pull' AND busy THEN 'BUSY' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n,
  LATERAL (SELECT coalesce(s.g = rg, false) AS own, coalesce(s.lid = rl AND s.lg = rg, false) AS mine, s.waiting OR s.lid IS NOT NULL AS busy, s.g IS NOT NULL AND NOT s.started AND NOT s.paused AND (s.q >= 2 OR s.closed AND s.q > 0) AS begins,
    s.g IS NOT NULL AND s.closed AND s.q = 0 AND s.lid IS NULL AS ends, s.g IS NOT NULL AND s.waiting AND s.started AND NOT s.paused AND s.lid IS NULL AND s.due IS NOT NULL AND s.due <= e.t AS serves) a,
  LATERAL (SELECT CASE WHEN s.ph = 0 AND s.lid IS NOT NULL AND s.lat + 2000 <= e.t THEN 'expire' WHEN s.ph = 0 AND serves THEN 'serve' WHEN s.ph = 0 THEN 'apply' WHEN s.ph = 1 THEN 'acked' WHEN s.ph = 2 THEN 'start' WHEN s.ph = 3 AND (ends OR serves) THEN 'serve' ELSE 'next' END AS act,
    CASE WHEN s.ph = 0 AND serves THEN s.due ELSE e.t END AS now) b,
  LATERAL (SELECT greatest(0, least(s.q - 1, (now - s.due - 100 + 19) // 20)) AS drops, k = 'ack' AND mine AND NOT s.lret AND own AND outcome IN ('sent', 'late') AS counts, k = 'ack' AND mine AND (s.lret OR own) AND outcome IN ('sent', 'late') AS tells) c)
SELECT user_id AS stream_id, o_at AS at_ms, o_kind AS kind, o_lease AS lease_id, o_g AS generation, o_pos AS position_ms, o_late AS late_ms, dropped, delivered, o_code AS code FROM s WHERE o_kind IS NOT NULL""")
def pull_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import folds

    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "signup", "activate").when(t == "purchase", F.when(i % 7 == 0, "close").when(i % 7 == 1, "pause").when(i % 7 == 2, "resume").when(i % 7 == 3, "deactivate").otherwise("frame"))
    kind = kind.when(t == "error", "ack").when(t == "click", "pull").otherwise("frame")
    outcome = F.when(i % 5 == 0, "late").when(i % 31 == 0, "outputUnavailable").when(i % 13 == 0, "cancelled").otherwise("sent")
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").select(
        F.col("user_id").alias("stream_id"), "event_id", (i * 7).alias("at_ms"), kind.alias("kind"), (i % 2 + 1).alias("generation"), (i % 9 * 100).alias("start_ms"), (i % 4 == 0).alias("paused"), F.lit(20).alias("ms"),
        (i % 300 + 1).alias("size"), (i % 3 + 1).alias("lease_id"), outcome.alias("outcome"),
    )
    return folds.fold(e, "stream_id", ["at_ms", "event_id"], folds.pull_step, folds.pull_start, folds.PULL)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, 't' || event_id % 5 AS name, CASE event_id % 2 WHEN 0 THEN 'SOURCE_AUTH_EXPIRED' ELSE 'DECODE_ERROR' END AS code,
  CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'play' ELSE 'ready' END WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'pause' WHEN 1 THEN 'play' ELSE 'seek' END WHEN 'purchase' THEN 'ended' ELSE 'failed' END AS k FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS i, NULL::VARCHAR AS cur, NULL::BIGINT AS gen, NULL::VARCHAR AS life, 0::BIGINT AS epoch, 'idle' AS state, 0::BIGINT AS made, 0::BIGINT AS version, ''::VARCHAR AS actions, ''::VARCHAR AS events, NULL::VARCHAR AS error FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT s.user_id, e.n, e.i, CASE WHEN inst AND k = 'plan' THEN name WHEN gone THEN NULL ELSE s.cur END, CASE WHEN inst THEN s.made + 1 WHEN gone THEN NULL ELSE s.gen END,
  CASE WHEN inst THEN CASE WHEN paused THEN 'dormant' ELSE 'starting' END WHEN la THEN 'starting' WHEN k = 'ready' AND hit THEN 'ready' WHEN gone THEN NULL ELSE s.life END,
  CASE WHEN inst THEN CASE WHEN paused THEN 0 ELSE 1 END WHEN k = 'play' AND s.cur IS NOT NULL THEN s.epoch + la::BIGINT + arm::BIGINT WHEN stops AND s.life = 'starting' THEN s.epoch + 1 ELSE s.epoch END,
  CASE WHEN inst THEN CASE WHEN paused THEN 'paused' ELSE 'buffering' END WHEN k = 'play' THEN CASE WHEN s.cur IS NULL THEN 'idle' WHEN paused AND s.life = 'ready' THEN 'playing' WHEN s.state <> 'playing' THEN 'buffering' ELSE s.state END
    WHEN stops THEN 'paused' WHEN k = 'ready' AND hit AND NOT paused THEN 'playing' WHEN gone THEN 'idle' ELSE s.state END,
  s.made + inst::BIGINT, CASE WHEN k = 'plan' AND e.i > s.version THEN e.i ELSE s.version END,
  CASE WHEN inst THEN CASE WHEN NOT paused THEN 'startCurrent(' || (s.made + 1) || ',1)' WHEN s.cur IS NOT NULL THEN 'cancelCurrent(' || s.gen || ')' ELSE '' END
    WHEN k = 'play' AND s.cur IS NOT NULL THEN concat_ws(';', CASE WHEN la THEN 'startCurrent(' || s.gen || ',' || (s.epoch + 1) || ')' END, CASE WHEN paused AND s.life <> 'dormant' THEN 'resumeCurrent(' || s.gen || ')' END,
      CASE WHEN arm THEN 'armStartupDeadline(current,' || s.gen || ',' || (s.epoch + la::BIGINT + 1) || ')' END)
    WHEN stops AND s.life <> 'dormant' THEN 'pauseCurrent(' || s.gen || ')' WHEN k = 'failed' AND gone THEN 'cancelCurrent(' || s.gen || ')' ELSE '' END,
  CASE WHEN k = 'seek' AND s.cur IS NULL THEN '' WHEN k = 'play' AND s.cur IS NULL OR k = 'ended' AND gone THEN 'stateChanged;nextNeeded'
    WHEN k = 'failed' AND gone THEN 'attemptFailed(' || s.cur || ',' || code || ');stateChanged;' || CASE WHEN code = 'DECODE_ERROR' THEN 'nextNeeded' ELSE 'sourceRefreshNeeded(current,' || s.cur || ')' END ELSE 'stateChanged' END,
  CASE WHEN k = 'seek' AND s.cur IS NULL THEN 'UNSUPPORTED' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1, LATERAL (SELECT s.state = 'paused' AS paused, s.cur IS NOT NULL AND e.i % 6 <> 0 AS hit,
    k = 'plan' AND e.i > s.version AND s.cur IS DISTINCT FROM name OR k = 'seek' AND s.cur IS NOT NULL AS inst, k = 'pause' AND s.state IN ('playing', 'buffering') AS stops, k = 'play' AND coalesce(s.life = 'dormant', false) AND s.state <> 'playing' AS la) x,
  LATERAL (SELECT k IN ('ended', 'failed') AND hit AS gone, k = 'play' AND paused AND (la OR coalesce(s.life = 'starting', false)) AS arm) y)
SELECT user_id AS stream_id, i AS log_seq, state AS play_state, coalesce(gen, made) AS generation, version AS plan_version, cur AS current, NULL::VARCHAR AS next, actions, events, error FROM s WHERE n > 0""")
def session_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session machine with a current track alone: plans, play, pause, seek, and what workers report of this or a stale
    generation."""
    from ..streaming import folds, session

    def step(s, row):
        i, kind = row["log_seq"], row["event_type"]
        now = s["current"]["generation"] if s["current"] else 0
        name = {"id": f"t{i % 5}", "kind": "url", "seekable": True}
        full = {
            "signup": {"kind": "plan", "plan_version": i, "current": name}, "view": {"kind": ("play", "prebufferReady")[i % 2]}, "click": {"kind": ("pause", "play", "seek")[i % 3], "seek_s": i % 60},
            "purchase": {"kind": "ended"}, "error": {"kind": "failed", "code": ("SOURCE_AUTH_EXPIRED", "DECODE_ERROR")[i % 2]},
        }[kind]
        return session.session_step(s, {"log_seq": i, "generation": now if i % 6 else now + 1, **full})

    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("log_seq"), "event_type")
    return folds.fold(e, "stream_id", ["log_seq"], step, session.session_start, session.SESSION)

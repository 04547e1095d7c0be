"""Every named query with the SQL that gives the same rows.

The driver's tables hold no audio, so they stand in for it: ``events`` for
reports, logs and counters (a user is a stream), ``embeddings`` for sample
arrays, ``lineitem`` for playlist segments, ``part`` for variants, ``pages``
for addresses.  The operators are the ones a media table would go through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numbers as N
from ..functions import rules as R
from ..operators import streams as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df



#: A total order of lineitem: its own key repeats.
LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
LINES_SQL = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax"

REPORTS_SQL = """SELECT event_id, user_id, ts, event_id * 37 % 256 AS fraction_lost, trunc(value * 1000)::BIGINT AS jitter_us,
  CASE WHEN event_type <> 'error' THEN event_id * 7919 % 600000 END AS rtt_us FROM events"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")
    return e.select(
        "event_id", "user_id", "ts", (F.col("event_id") * 37 % 256).alias("fraction_lost"), (F.col("value") * 1000).cast("long").alias("jitter_us"),
        F.when(F.col("event_type") != "error", F.col("event_id") * 7919 % 600_000).alias("rtt_us"),
    )


@query(f"""
WITH r AS ({REPORTS_SQL}),
w AS (SELECT event_id, user_id, count(*) OVER x AS window_n, sum(fraction_lost) OVER x * 100.0::DOUBLE / (count(*) OVER x * 256.0::DOUBLE) AS loss,
  max(fraction_lost) OVER x * 100.0::DOUBLE / 256.0::DOUBLE AS max_loss, (sum(jitter_us) OVER x // count(*) OVER x)::BIGINT AS jitter, max(jitter_us) OVER x AS max_jitter,
  (sum(rtt_us) OVER x // nullif(count(rtt_us) OVER x, 0))::BIGINT AS rtt, max(rtt_us) OVER x AS max_rtt
  FROM r WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, window_n, round(loss, 6) AS window_loss, round(max_loss, 6) AS window_max_loss, jitter AS window_jitter, max_jitter AS window_max_jitter,
  rtt AS window_rtt, max_rtt AS window_max_rtt,
  CASE WHEN loss >= 10 OR max_jitter >= 80000 OR coalesce(rtt, 0) >= 500000 THEN 'poor'
       WHEN loss >= 2 OR max_jitter >= 30000 OR coalesce(rtt, 0) >= 200000 THEN 'degraded' ELSE 'good' END AS level FROM w""")
def quality_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.rolling_quality(reports(spark, sf_dir), "user_id", ["ts", "event_id"])
    loss = [N.rounded(F.col(c), 6).alias(c) for c in ("window_loss", "window_max_loss")]
    return out.select("event_id", "user_id", "window_n", *loss, "window_jitter", "window_max_jitter", "window_rtt", "window_max_rtt", "level")


@query("""
WITH r AS (SELECT event_id, event_id % 5 * 900000000 AS lsr, event_id * 7919 % 4294967296 AS arrival, event_id % 7 * 1000 AS delay FROM events),
e AS (SELECT *, ((arrival - lsr) % 4294967296 + 4294967296) % 4294967296 AS elapsed FROM r)
SELECT event_id, CASE WHEN lsr <> 0 AND elapsed >= delay THEN (elapsed - delay) * 1000000 // 65536 END AS rtt_us,
  event_id * 13 % 100000 * 1000000 // 48000 AS jitter_us FROM e""")
def rtcp_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rtt = N.round_trip_micros(N.wrap(i * 7919), i % 5 * 900_000_000, i % 7 * 1000)
    return read(spark, sf_dir, "events", "event_id").select("event_id", rtt.alias("rtt_us"), N.jitter_micros(i * 13 % 100_000).alias("jitter_us"))


@query("""
SELECT user_id, event_id, row_number() OVER w AS ordinal, greatest(x - coalesce(lag(x) OVER w, x), 0) AS delta,
  max(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak
FROM (SELECT *, event_id * 7919 % 100000 AS x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts").withColumn("x", F.col("event_id") * 7919 % 100_000)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        "user_id", "event_id", F.row_number().over(w).cast("long").alias("ordinal"), S.counter_delta(F.col("x"), "user_id", ["ts", "event_id"]).alias("delta"),
        F.max("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"),
    )


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(CASE WHEN place = 0 THEN value END) AS lowest, max(CASE WHEN place = floor((n - 1) * 0.5::DOUBLE) THEN value END) AS p50,
  max(CASE WHEN place = floor((n - 1) * 0.95::DOUBLE) THEN value END) AS p95, max(CASE WHEN place = n - 1 THEN value END) AS highest FROM r GROUP BY event_type""")
def soak_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.floor_percentiles(read(spark, sf_dir, "events", "event_type", "value"), "event_type", "value", {"lowest": 0.0, "p50": 0.5, "p95": 0.95, "highest": 1.0})


@query("""SELECT user_id, sum(event_id * 7919 % 1000)::BIGINT AS packets, max(event_id * 13 % 400) AS max_lateness, count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type NOT IN ('error', 'view')) AS others, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id""")
def soak_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = read(spark, sf_dir, "events", "user_id", "event_id", "event_type"), F.col("event_type")
    return e.groupBy("user_id").agg(
        F.sum(F.col("event_id") * 7919 % 1000).alias("packets"), F.max(F.col("event_id") * 13 % 400).alias("max_lateness"), F.count_if(kind == "error").alias("errors"),
        F.count_if(kind == "view").alias("views"), F.count_if(~kind.isin("error", "view")).alias("others"), F.bool_or(kind == "error").alias("any_error"),
    )


@query("""SELECT user_id, event_id, version FROM (SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT *, event_id * 7919 % 1000 AS version FROM events)) WHERE version > coalesce(before, 0)""")
def plan_version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts").withColumn("version", F.col("event_id") * 7919 % 1000)
    return S.version_gate(e, "user_id", ["ts", "event_id"], "version").select("user_id", "event_id", "version")


@query("""WITH g AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id % 3 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current_generation FROM events)
SELECT user_id, event_id, current_generation FROM g WHERE event_type <> 'signup' AND event_id % 3 = current_generation""")
def generation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type")
    claim, starts = F.col("event_id") % 3, F.col("event_type") == "signup"
    out = e.withColumn("current_generation", S.as_of(e, "user_id", ["ts", "event_id"], F.when(starts, claim)))
    return out.where(~starts & (claim == F.col("current_generation"))).select("user_id", "event_id", "current_generation")


@query("""SELECT event_id, event_type, user_id FROM (SELECT *, lead(event_type) OVER w = event_type AND lead(user_id) OVER w = user_id AND event_type IN ('view', 'click') AS again
  FROM (SELECT *, user_id % 7 AS drain FROM events) WINDOW w AS (PARTITION BY drain ORDER BY ts, event_id)) WHERE NOT coalesce(again, false)""")
def event_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "event_type", "user_id", "ts")
    return S.coalesce_adjacent(e, ["ts", "event_id"], "event_type", "user_id", ("view", "click"), F.col("user_id") % 7, F.to_date("ts")).select("event_id", "event_type", "user_id")


@query("SELECT event_id, event_type, CASE WHEN user_id = 7 THEN 'drained' ELSE 'kept' END AS side FROM events")
def event_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("user_id") == 7, "drained").otherwise("kept")
    return read(spark, sf_dir, "events", "event_id", "event_type", "user_id").select("event_id", "event_type", side.alias("side"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END, event_id)::INTEGER AS place FROM events""")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy(rank, "event_id")
    return read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type").select("user_id", "event_id", F.row_number().over(w).alias("place"))


@query("""WITH last AS (SELECT user_id, event_type AS state, event_id AS generation FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
own AS (SELECT user_id AS id, 0 AS copy FROM last UNION ALL SELECT user_id, 1 FROM last WHERE user_id % 7 = 0 UNION ALL SELECT user_id + 1000000, 0 FROM last WHERE user_id % 10 = 0)
SELECT id, copy, state IS NOT NULL AND state <> 'signup' AS ok, CASE WHEN state <> 'signup' THEN generation END AS generation,
  CASE WHEN state IS NULL THEN 'STREAM_NOT_FOUND' WHEN state = 'signup' THEN 'BUSY' END AS code FROM own LEFT JOIN last ON last.user_id = own.id""")
def status_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is asked for, some twice, and some that don't exist."""
    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("x"))
    last = last.select("user_id", F.col("x.event_type").alias("state"), F.col("x.event_id").alias("generation"))
    id_ = F.col("user_id")
    asked = F.concat(F.array(F.struct(id_.alias("id"), F.lit(0).alias("copy"))), *[F.when(c, F.array(F.struct(x.alias("id"), F.lit(n).alias("copy")))).otherwise(F.array()) for c, x, n in ((id_ % 7 == 0, id_, 1), (id_ % 10 == 0, id_ + 1_000_000, 0))])
    ids = last.select(F.explode(asked).alias("x")).select("x.id", "x.copy")
    return S.status_lookup(ids, last.withColumnRenamed("user_id", "id").withColumn("starting", F.col("state") == "signup"), "id").select("id", "copy", "ok", "generation", "code")


@query("""SELECT vec_id, round(peak, 9) AS peak, round(CASE WHEN peak <= 0 THEN -120 ELSE greatest(20 * log10(peak), -120) END, 6) AS dbfs, peak <= 1 AS in_range
FROM (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings)""")
def pcm_peak_dbfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("p", A.peak(F.col("embedding")))
    return e.select("vec_id", N.rounded(F.col("p"), 9).alias("peak"), N.rounded(N.dbfs(F.col("p")), 6).alias("dbfs"), A.in_range(F.col("embedding")).alias("in_range"))


_SAMPLED_SQL = "SELECT vec_id, (unnest(range(1, len(embedding) + 1)) - 1)::INTEGER AS place, unnest(embedding)::DOUBLE AS x FROM embeddings"


def _each_sample(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.posexplode(F.transform("embedding", lambda x: N.rounded(f(x.cast("double")), 9))).alias("place", "y"))


@query(f"SELECT vec_id, place, round(greatest(least(x * 4, 1), -1), 9) AS y FROM ({_SAMPLED_SQL})")
def pcm_gain_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_sample(spark, sf_dir, lambda x: N.hard_gain(x, 4.0))


@query(f"""SELECT vec_id, place, round(CASE WHEN abs(x * 4) <= 0.95 THEN x * 4 ELSE sign(x) * least(0.95 + 0.05 * (1 - exp(-(abs(x * 4) - 0.95) / 0.05::DOUBLE)), 1) END, 9) AS y
FROM ({_SAMPLED_SQL})""")
def pcm_soft_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_sample(spark, sf_dir, lambda x: N.soft_limit(x * 4.0))


@query("""SELECT vec_id, list_transform(range(0, len(embedding) // 4), lambda i: round(greatest(least(embedding[4*i+1]::DOUBLE + (embedding[4*i+3]::DOUBLE + embedding[4*i+4]::DOUBLE) * 0.25, 1), -1), 9)) AS l,
  list_transform(range(0, len(embedding) // 4), lambda i: round(greatest(least(embedding[4*i+2]::DOUBLE + (embedding[4*i+3]::DOUBLE + embedding[4*i+4]::DOUBLE) * 0.25, 1), -1), 9)) AS r FROM embeddings WHERE len(embedding) % 4 = 0""")
def pcm_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", A.downmix(F.col("embedding"), 4).alias("s")).where("s IS NOT NULL")
    side = lambda c: F.transform(F.filter("s", lambda x, i: i % 2 == c), lambda x: N.rounded(x, 9))
    return e.select("vec_id", side(0).alias("l"), side(1).alias("r"))


@query(f"""WITH s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, place) - 1 AS i, round(x, 7) AS x FROM ({_SAMPLED_SQL}) JOIN embeddings USING (vec_id)),
f AS (SELECT label, i // 48 AS frame, list(x ORDER BY i) AS v FROM s GROUP BY ALL)
SELECT label, frame::BIGINT AS frame, (frame * 48)::BIGINT AS position, len(v)::INTEGER AS n_values, list_concat(v, list_transform(range(0, 48 - len(v)), lambda i: 0.0::DOUBLE)) AS samples FROM f""")
def pcm_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    s = e.select("label", "vec_id", F.transform("embedding", lambda x: N.rounded(x.cast("double"), 7)).alias("x"))
    return S.count_windows(s, "label", ["vec_id"], "x", 48)


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice / 100 - 12 END AS tg, CASE WHEN p_size % 4 <> 0 THEN p_size / 4.0::DOUBLE - 6 END AS ag,
  CASE WHEN p_size % 5 <> 0 THEN p_size / 40.0::DOUBLE END AS tp, 0.8::DOUBLE AS ap FROM part),
c AS (SELECT p_partkey, CASE WHEN tg IS NOT NULL THEN 'track' ELSE 'album' END AS source, coalesce(tg, ag) + 2 AS asked, CASE WHEN tg IS NOT NULL THEN tp ELSE ap END AS peak FROM p WHERE coalesce(tg, ag) IS NOT NULL),
m AS (SELECT *, CASE WHEN peak IS NOT NULL THEN -1 - CASE WHEN peak <= 0 THEN -120 ELSE greatest(20 * log10(peak), -120) END END AS most FROM c),
k AS (SELECT *, coalesce(asked > most, false) AS clipped, CASE WHEN asked > most THEN most ELSE asked END AS capped FROM m)
SELECT p_partkey, source, round(asked, 4) AS requested_db, round(greatest(least(capped, 12), -60) * 100)::INTEGER AS gain_cb, clipped AS clipping_limited,
  abs(greatest(least(capped, 12), -60) - capped) > 0.0001 AS range_limited FROM k""")
def replay_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    g = N.replay_gain(
        F.when(size % 3 != 0, F.col("p_retailprice") / 100 - 12), F.when(size % 4 != 0, size / 4 - 6), F.when(size % 5 != 0, size / 40), F.lit(0.8), preamp=2.0, target_peak=-1.0
    )
    out = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", g.alias("g")).where("g IS NOT NULL")
    return out.select("p_partkey", "g.source", N.rounded(F.col("g.requested_db"), 4).alias("requested_db"), F.round(F.col("g.gain_db") * 100).cast("int").alias("gain_cb"), "g.clipping_limited", "g.range_limited")


@query("""SELECT l_discount AS unit, count(*) AS n, round(CASE WHEN l_discount <= 0 THEN NULL ELSE -60 + 60 * pow(l_discount, 0.5) END, 6) AS db,
  round(CASE WHEN l_discount <= 0 THEN 0 ELSE pow(10, (-60 + 60 * pow(l_discount, 0.5)) / 20) END, 9) AS gain, round(l_discount * 10000)::INTEGER AS units FROM lineitem GROUP BY l_discount""")
def volume_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("unit")
    db = N.volume_db(unit)
    return read(spark, sf_dir, "lineitem", "l_discount").groupBy(F.col("l_discount").alias("unit")).agg(F.count("*").alias("n")).select(
        "unit", "n", N.rounded(F.when(unit > 0, db), 6).alias("db"), N.rounded(F.when(unit > 0, N.db_to_linear(db)).otherwise(0.0), 9).alias("gain"), N.volume_units(unit).alias("units")
    )


_URL = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d+))?([^?#]*)'"


@query(f"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, {_URL}, 1)) AS scheme, lower(regexp_extract(url, {_URL}, 3)) AS host, regexp_extract(url, {_URL}, 2) AS auth, regexp_extract(url, {_URL}, 4) AS port FROM pages)
SELECT page_id, scheme, host, CASE WHEN url IS NULL OR scheme NOT IN ('http', 'https') OR host = '' THEN 'INVALID_SOURCE' END AS provider,
  CASE WHEN url IS NULL OR scheme <> 'https' OR host = '' OR auth <> '' OR port NOT IN ('', '443') THEN 'INVALID_SOURCE' END AS public_only,
  nullif(lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '\\.([A-Za-z0-9]{{1,16}})$', 1)), '') AS extension FROM u""")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", F.lower(R.url_part(url, "protocol")).alias("scheme"), F.lower(R.url_part(url, "host")).alias("host"), R.url_policy(url).alias("provider"),
        R.url_policy(url, True).alias("public_only"), R.url_extension(url).alias("extension"),
    )


#: Written down here by the first and last address, apart from the rule.
_PRIVATE_SQL = """n < 16777216 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 1681915904 AND 1686110207 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183
  OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3221225472 AND 3221225727 OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3227017984 AND 3227018239 OR n BETWEEN 3232235520 AND 3232301055
  OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n >= 3758096384"""


@query(f"""SELECT event_id, address, NOT ({_PRIVATE_SQL}) AS public FROM (SELECT event_id, n, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS address
  FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS n FROM events))""")
def public_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * 2_654_435_761 % N.U32
    parts = [N.idiv(n, 1 << 24), N.idiv(n, 1 << 16) % 256, N.idiv(n, 256) % 256, n % 256]
    e = read(spark, sf_dir, "events", "event_id").select("event_id", F.concat_ws(".", *[p.cast("string") for p in parts]).alias("address"))
    return e.select("event_id", "address", R.public_ipv4(R.ipv4(F.col("address"))).alias("public"))


_VARIANTS_SQL = """SELECT p_partkey AS ord, p_brand AS master, CASE WHEN p_partkey % 4 <> 0 THEN 'g' || (p_size % 7) END AS audio_group, p_size * 1000 AS bandwidth, p_size % 6 = 0 AS sized,
  CASE p_partkey % 5 WHEN 0 THEN 'mp4a.40.2' WHEN 1 THEN 'avc1.64, mp4a.40.2' WHEN 2 THEN 'ec-3' WHEN 3 THEN NULL ELSE 'opus' END AS codecs, p_partkey % 11 = 0 AS is_i_frame FROM part"""
_RENDITIONS_SQL = """SELECT p_partkey AS ord, p_brand AS master, 'g' || (p_size % 9) AS audio_group, CASE WHEN p_partkey % 2 = 0 THEN 'audio' || p_partkey END AS uri, p_partkey % 5 = 0 AS is_default,
  p_partkey % 3 <> 0 AS autoselect, CASE p_size % 4 WHEN 0 THEN '2' WHEN 1 THEN '6' WHEN 2 THEN '1/x' END AS channels FROM part WHERE p_partkey % 7 < 3 AND p_size % 3 = 0 AND substr(p_brand, 7, 1) IN ('1', '2', '3')"""


@query(f"""WITH v AS (SELECT *, CASE WHEN codecs LIKE '%mp4a.40.2%' THEN 0 WHEN codecs = 'ec-3' THEN 2 ELSE 1 END AS rank, coalesce(codecs LIKE '%avc1.%', false) OR sized AS video FROM ({_VARIANTS_SQL})),
g AS (SELECT master, audio_group, min(rank) AS rank, min(bandwidth) AS bandwidth FROM v WHERE audio_group IS NOT NULL GROUP BY ALL),
a AS (SELECT r.*, g.rank, g.bandwidth, row_number() OVER (PARTITION BY r.master ORDER BY coalesce(g.rank, 1), NOT is_default, NOT autoselect, CASE WHEN channels IN ('2', '1/x') THEN 0 ELSE 1 END, coalesce(g.bandwidth, 9223372036854775807), r.ord) AS place
  FROM ({_RENDITIONS_SQL}) r LEFT JOIN g ON g.master = r.master AND g.audio_group = r.audio_group WHERE uri IS NOT NULL AND (g.rank IS NOT NULL OR r.master NOT IN (SELECT master FROM g)) AND coalesce(g.rank, 1) <> 2),
b AS (SELECT *, row_number() OVER (PARTITION BY master ORDER BY rank = 2, video, rank, bandwidth, ord) AS place FROM v WHERE NOT is_i_frame)
SELECT b.master, CASE WHEN a.ord IS NOT NULL THEN 'rendition' ELSE 'variant' END AS branch, coalesce(a.ord, b.ord) AS ord FROM b LEFT JOIN a ON a.master = b.master AND a.place = 1 WHERE b.place = 1""")
def variant_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key, size = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), F.col("p_partkey"), F.col("p_size")
    codecs = F.when(key % 5 == 0, "mp4a.40.2").when(key % 5 == 1, "avc1.64, mp4a.40.2").when(key % 5 == 2, "ec-3").when(key % 5 == 4, "opus")
    own = [key.alias("ord"), F.col("p_brand").alias("master")]
    v = p.select(
        *own, F.when(key % 4 != 0, F.concat(F.lit("g"), (size % 7).cast("string"))).alias("audio_group"), (size.cast("long") * 1000).alias("bandwidth"), codecs.alias("codecs"),
        (size % 6 == 0).alias("sized"), (key % 11 == 0).alias("is_i_frame"),
    )
    r = p.where((key % 7 < 3) & (size % 3 == 0) & F.substring("p_brand", 7, 1).isin("1", "2", "3")).select(
        *own, F.concat(F.lit("g"), (size % 9).cast("string")).alias("audio_group"), F.when(key % 2 == 0, F.concat(F.lit("audio"), key.cast("string"))).alias("uri"), (key % 5 == 0).alias("is_default"),
        (key % 3 != 0).alias("autoselect"), F.when(size % 4 == 0, "2").when(size % 4 == 1, "6").when(size % 4 == 2, "1/x").alias("channels"),
    )
    v = v.withColumns({"rank": R.codec_rank(F.col("codecs")), "has_video": R.has_video(F.col("codecs")) | F.col("sized")})
    return S.choose_media(v, r.withColumn("channel_rank", R.channel_rank(F.col("channels"))), "master", "ord")


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES_SQL}) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
WHERE l_orderkey % 4 = 0 OR place > n - 3""")
def live_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = read(spark, sf_dir, "lineitem", "l_orderkey", *LINES)
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINES)).cast("long"))
    return S.live_edge(own, "l_orderkey", ["place"], F.col("l_orderkey") % 4 == 0).select("l_orderkey", "l_partkey", "l_linenumber", "place")


_SEGMENTS_SQL = f"""SELECT l_orderkey AS playlist, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES_SQL}) AS idx, l_partkey % 2 AS uri, CASE WHEN l_suppkey % 7 <> 0 THEN l_quantity::BIGINT END AS range_len,
  CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 7 <> 0 THEN l_suppkey * 100 END AS range_off FROM lineitem"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = read(spark, sf_dir, "lineitem", "l_orderkey", *LINES)
    ranged = F.col("l_suppkey") % 7 != 0
    return own.select(
        F.col("l_orderkey").alias("playlist"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINES)).cast("long").alias("idx"), (F.col("l_partkey") % 2).alias("uri"),
        F.when(ranged, F.col("l_quantity").cast("long")).alias("range_len"), F.when(ranged & (F.col("l_partkey") % 3 == 0), F.col("l_suppkey") * 100).alias("range_off"),
    )


@query(f"""WITH s AS ({_SEGMENTS_SQL}),
f AS (SELECT *, range_off IS NOT NULL OR NOT coalesce(lag(uri) OVER w = uri AND lag(range_len) OVER w IS NOT NULL, false) AS fresh FROM s WINDOW w AS (PARTITION BY playlist ORDER BY idx)),
r AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY playlist ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM f),
o AS (SELECT *, first_value(range_off) OVER w + coalesce(sum(range_len) OVER (PARTITION BY playlist, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r WINDOW w AS (PARTITION BY playlist, run ORDER BY idx))
SELECT playlist, idx, uri, range_len, off::BIGINT AS "offset", CASE WHEN range_len IS NOT NULL AND (off IS NULL OR range_len <= 0) THEN 'INVALID_SOURCE' END AS error FROM o""")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.byte_offsets(segments(spark, sf_dir), "playlist", ["idx"]).select("playlist", "idx", "uri", "range_len", "offset", "error")


@query(f"""SELECT l_orderkey, place, last_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS key
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES_SQL}, l_returnflag) AS place FROM lineitem)""")
def key_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", *LINES)
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINES, "l_returnflag")).cast("long"))
    return own.select("l_orderkey", "place", S.as_of(own, "l_orderkey", ["place"], F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("key"))


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) = 1 AS leads, (c_acctbal::BIGINT * 1024 + 20000000000 + 1048575) // 1048576 AS units
FROM (SELECT * REPLACE (trunc(c_acctbal) AS c_acctbal) FROM customer)""")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    out = S.single_flight(c, F.concat_ws("\u0001", "c_mktsegment", "c_nationkey"), ["c_custkey"])
    return out.select("c_custkey", "leads", N.quota_units(F.col("c_acctbal").cast("long") * 1024 + 20_000_000_000).alias("units"))


@query("""WITH s AS (SELECT event_id, user_id, row_number() OVER w - 1 AS sent, sum(d) OVER w - d AS samples FROM (SELECT *, CASE WHEN event_type = 'error' THEN 480 ELSE 960 END AS d FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, (65000 + sent) % 65536 AS sequence, ((4294900000 + samples) % 4294967296)::BIGINT AS rtp_timestamp, (samples * 1000 // 48000)::BIGINT AS position_ms, '80' || CASE WHEN sent = 0 THEN 'ef' ELSE '6f' END
  || lpad(lower(to_hex((65000 + sent) % 65536)), 4, '0') || lpad(lower(to_hex(((4294900000 + samples) % 4294967296)::BIGINT)), 8, '0') || lpad(lower(to_hex(user_id)), 8, '0') AS header FROM s""")
def rtp_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").withColumn("d", F.when(F.col("event_type") == "error", 480).otherwise(960).cast("long"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = e.select("event_id", "user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("sent"), (F.sum("d").over(w) - F.col("d")).alias("samples"))
    seq, ts = N.wrap(F.col("sent") + 65_000, N.U16), N.wrap(F.col("samples") + 4_294_900_000)
    return s.select("event_id", seq.alias("sequence"), ts.alias("rtp_timestamp"), N.duration_ms(F.col("samples"), 48_000).alias("position_ms"), F.lower(F.hex(N.rtp_header(F.col("sent") == 0, 111, seq, ts, F.col("user_id")))).alias("header"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 20 WHEN 'signup' THEN 60 WHEN 'click' THEN 500 END AS d, event_type = 'error' AS cleared FROM events),
q AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS held, 0::BIGINT AS buffered_ms, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT e.user_id, e.n, e.event_id, CASE WHEN cleared THEN [] WHEN d IS NULL THEN q.held[2:] WHEN d > 400 OR q.buffered_ms + d > 400 THEN q.held ELSE list_append(q.held, d) END,
  CASE WHEN cleared THEN 0 WHEN d IS NULL THEN q.buffered_ms - coalesce(q.held[1], 0) WHEN d > 400 OR q.buffered_ms + d > 400 THEN q.buffered_ms ELSE q.buffered_ms + d END::BIGINT,
  CASE WHEN cleared THEN 'cleared' WHEN d IS NULL THEN CASE WHEN len(q.held) = 0 THEN 'empty' ELSE 'sent' END WHEN d > 400 THEN 'INVALID_CONFIG' WHEN q.buffered_ms + d > 400 THEN 'blocked' ELSE 'queued' END
  FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1)
SELECT event_id, user_id, buffered_ms, outcome FROM q WHERE n > 0""")
def queue_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import folds

    t = F.col("event_type")
    duration = F.when(t == "view", 20).when(t == "signup", 60).when(t == "click", 500)
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").select("event_id", "user_id", "ts", duration.alias("duration"), (t == "error").alias("cleared"))
    return folds.fold(e, "user_id", ["ts", "event_id"], folds.bounded_step, folds.bounded_start, folds.BOUNDED)


@query("""SELECT user_id, hour, n, CASE WHEN seconds > 0 THEN round(n / (3 * seconds * 50.0::DOUBLE) * 1000) / 1000 ELSE 0 END AS coverage FROM
(SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n, (epoch(max(date_trunc('second', ts))) - epoch(min(date_trunc('second', ts))))::BIGINT AS seconds FROM events GROUP BY ALL)""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = read(spark, sf_dir, "events", "user_id", "ts").select("user_id", at.alias("at"), (N.idiv(at, 3600) * 3600).alias("hour"))
    out = e.groupBy("user_id", "hour").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("seconds"))
    return out.select("user_id", "hour", "n", N.coverage_ratio(F.col("n"), F.lit(3), F.col("seconds")).alias("coverage"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 + 2208988800 AS seconds, epoch_us(ts) % 1000000 * 4294967296 // 1000000 AS fraction,
  (epoch_us(ts) // 1000000 + 2208988800) % 65536 * 65536 + (epoch_us(ts) % 1000000 * 4294967296 // 1000000) // 65536 AS compact FROM events""")
def sender_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events", "event_id", "ts").select("event_id", N.ntp_seconds(at).alias("seconds"), N.ntp_fraction(at).alias("fraction"), N.ntp_compact(at).alias("compact"))


@query("""SELECT event_id, CASE WHEN t THEN 'SOURCE_TIMEOUT' WHEN s IN (401, 403) THEN 'SOURCE_AUTH_EXPIRED' ELSE 'INVALID_SOURCE' END AS code, t OR s IS NULL OR s IN (408, 429) OR s BETWEEN 500 AND 599 AS retryable
FROM (SELECT event_id, event_id % 17 = 0 AS t, CASE WHEN event_id % 19 <> 0 THEN 399 + event_id % 130 END AS s FROM events)""")
def retry_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    timeout, status = i % 17 == 0, F.when(i % 19 != 0, i % 130 + 399)
    return read(spark, sf_dir, "events", "event_id").select("event_id", N.http_error_code(status, timeout).alias("code"), N.http_retryable(status, timeout).alias("retryable"))


@query("""SELECT event_id, CASE WHEN hls THEN 'hls' WHEN kind = 'live' THEN 'live' WHEN detected IN ('hls', 'live') AND role = 'current' THEN detected WHEN detected IN ('hls', 'live') THEN 'UNSUPPORTED' ELSE 'artifact' END AS route,
  NOT hls AND kind <> 'live' AND coalesce(asked, true) AS seekable FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'file' WHEN 'error' THEN 'live' ELSE 'url' END AS kind, event_id % 11 = 0 AS hls,
  CASE event_id % 5 WHEN 0 THEN 'hls' WHEN 1 THEN 'live' ELSE 'none' END AS detected, CASE WHEN event_id % 2 = 0 THEN 'current' ELSE 'next' END AS role, CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS asked FROM events)""")
def source_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "view", "file").when(t == "error", "live").otherwise("url")
    hint = F.when(i % 11 == 0, "M3U8").otherwise("mp3")
    hls = R.is_hls(F.lit("https://host/a.mp3"), hint)
    detected = F.when(i % 5 == 0, "hls").when(i % 5 == 1, "live").otherwise("none")
    asked = F.when(i % 3 == 0, F.lit(False)).when(i % 3 == 1, F.lit(True))
    return read(spark, sf_dir, "events", "event_id", "event_type").select(
        "event_id", R.route(kind, hls, detected, F.when(i % 2 == 0, "current").otherwise("next")).alias("route"), R.seekable(kind, hls, asked).alias("seekable")
    )


@query("""SELECT playlist, idx, uri, cc, CASE WHEN lag(cc) OVER w IS NULL THEN true ELSE cc = (lag(cc) OVER w + 1) % 16 END AS continuous FROM
(SELECT user_id AS playlist, event_id AS idx, event_type AS uri, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) % 16 AS cc FROM events) WINDOW w AS (PARTITION BY playlist ORDER BY idx)""")
def continuity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("playlist").orderBy("idx")
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select(F.col("user_id").alias("playlist"), F.col("event_id").alias("idx"), F.col("event_type").alias("uri"))
    e = e.withColumn("cc", ((F.row_number().over(w) + F.when(F.col("idx") % 50 == 0, 1).otherwise(0)) % 16).cast("long"))
    before = F.lag("cc").over(w)
    return e.select("*", F.when(before.isNull(), F.lit(True)).otherwise(F.col("cc") == (before + 1) % 16).alias("continuous"))


@query("""WITH b AS (SELECT user_id, event_id, ts, event_id % 97 > 4 AS bad FROM events), r AS (SELECT *, sum((NOT bad)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, length, "first" FROM (SELECT user_id, run, count(*) AS length, min(event_id) AS "first" FROM r WHERE bad GROUP BY ALL) WHERE length > 32""")
def decode_error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts")
    return S.long_runs(e, "user_id", ["ts", "event_id"], F.col("event_id") % 97 > 4, 32)


@query("""SELECT o_orderkey, CASE WHEN frame <= 0 OR prebuffer <= 0 OR capacity <= 0 OR batch <= 0 OR prime < 0 OR lateness < 0 OR batch > 1000 OR capacity > 10000 OR prebuffer > capacity OR prime > capacity OR lateness > capacity THEN 'INVALID_CONFIG' END AS buffers,
  CASE WHEN rate <> 48000 OR channels NOT BETWEEN 1 AND 2 OR complexity NOT BETWEEN 0 AND 10 OR bitrate NOT BETWEEN 500 AND 512000 THEN 'INVALID_CONFIG' END AS encoder,
  CASE WHEN preloads <= 0 OR producers <= 0 OR preloads >= producers OR http < 2 THEN 'INVALID_CONFIG' END AS limits,
  CASE WHEN port NOT BETWEEN 1 AND 65535 OR mtu NOT BETWEEN 64 AND 65507 OR pt NOT BETWEEN 0 AND 127 THEN 'INVALID_CONFIG' WHEN o_orderkey % 6 = 0 THEN 'UNSUPPORTED' END AS output,
  CASE WHEN o_orderkey % 5 = 0 THEN 'UNSUPPORTED' WHEN o_custkey % 9 - 1 <= 0 THEN 'INVALID_CONFIG' END AS next_source
FROM (SELECT o_orderkey, o_custkey, 20 AS frame, o_custkey % 700 AS prebuffer, o_orderkey % 12000 AS capacity, o_custkey % 500 AS prime, o_orderkey % 1100 AS batch, o_custkey % 300 AS lateness,
  CASE WHEN o_custkey % 8 = 0 THEN 44100 ELSE 48000 END AS rate, o_orderkey % 3 AS channels, o_custkey % 12 AS complexity, o_orderkey * 37 % 600000 AS bitrate, o_custkey % 5 AS preloads, o_orderkey % 6 AS producers,
  o_custkey % 4 AS http, o_orderkey * 101 % 70000 AS port, o_custkey % 1500 AS mtu, o_orderkey % 140 AS pt FROM orders)""")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, one = F.col("o_orderkey"), F.col("o_custkey"), F.lit(1)
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        "o_orderkey", R.buffers(F.lit(20), c % 700, k % 12_000, c % 500, k % 1100, c % 300).alias("buffers"),
        R.encoder(F.when(c % 8 == 0, 44_100).otherwise(48_000), k % 3, c % 12, k * 37 % 600_000).alias("encoder"),
        R.limits(one, k % 6, c % 5, c % 4, one, F.lit(4 << 20)).alias("limits"),
        R.rtp_output(k * 101 % 70_000, F.lit(None).cast("int"), c % 1500, k % 140, F.when(k % 6 == 0, "aes").otherwise("none")).alias("output"),
        R.next_source(k % 5 == 0, F.lit(False), c % 9 - 1).alias("next_source"),
    )


@query("""SELECT page_id, CASE WHEN length(trim(coalesce(CASE WHEN page_id % 13 <> 0 THEN 'track' END, ''))) = 0 OR octet_length(encode(url)) > 40 AND page_id % 4 = 0 OR page_id % 9 = 0 THEN 'INVALID_SOURCE' END AS track FROM
(SELECT page_id, url FROM pages)""")
def track_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, url = F.col("page_id"), F.col("url")
    id_ = F.when(i % 13 != 0, "track").otherwise(" ")
    hint = F.when(i % 9 == 0, "audio/mpeg").otherwise("mp3")
    long_url = F.when((F.octet_length(url) > 40) & (i % 4 == 0), F.repeat(F.lit("x"), (16 << 10) + 1)).otherwise(url)
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", R.track(F.lit("url"), id_, F.lit("attempt"), long_url, F.lit(None).cast("string"), hint).alias("track"))


@query("""WITH f AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'error' OR user_id % 13 = 0 THEN 0 ELSE 20 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS produced, user_id % 7 * 300 AS prime FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN produced >= prime AND produced > 0 THEN 0 ELSE 1 END, CASE WHEN produced >= prime AND produced > 0 THEN ts END, CASE WHEN produced >= prime AND produced > 0 THEN event_id END, ts DESC, event_id DESC) AS place FROM f)
SELECT user_id, event_id, produced, produced > 0 AS ready, produced < prime AS ended_short, CASE WHEN produced = 0 THEN 'DECODE_ERROR' END AS code FROM o WHERE place = 1""")
def next_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    frame = F.when((F.col("event_type") == "error") | (F.col("user_id") % 13 == 0), 0).otherwise(20)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type").withColumn("produced", F.sum(frame).over(w))
    return S.primed(e, "user_id", ["ts", "event_id"], "produced", F.col("user_id") % 7 * 300).select("user_id", "event_id", "produced", "ready", "ended_short", "code")


@query("""SELECT e.user_id, e.event_id, p.event_id AS progress_id FROM events e LEFT JOIN (SELECT user_id, event_id % 4 AS generation, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p
  ON p.user_id = e.user_id AND p.generation = e.event_id % 4 WHERE e.event_type = 'click'""")
def progress_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").withColumn("generation", F.col("event_id") % 4)
    p = e.where("event_type = 'purchase'").groupBy("user_id", "generation").agg(F.max("event_id").alias("progress_id"))
    return e.where("event_type = 'click'").join(p, ["user_id", "generation"], "left").select("user_id", "event_id", "progress_id")


@query("""WITH s AS (SELECT user_id, event_id AS sent, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events)
SELECT user_id, sent + unnest(range(1, greatest((after - sent - 1) // 20, 0) + 1)) * 20 AS fill_at FROM s WHERE after IS NOT NULL""")
def keepalive_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gap_frames(read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at")), "user_id", "at", 20)


@query("""WITH e AS (SELECT event_id, user_id % 20 AS flight, user_id, event_type AS k FROM events),
s AS (SELECT e.*, (SELECT count(*) FROM e u WHERE u.flight = e.flight AND u.user_id = e.user_id AND u.k = 'signup' AND u.event_id <= e.event_id
  AND NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.k = 'error' AND x.event_id > u.event_id AND x.event_id <= e.event_id)) > 0 AS here FROM e),
p AS (SELECT *, here AND coalesce(last_value(CASE k WHEN 'purchase' THEN false WHEN 'view' THEN true WHEN 'signup' THEN true END IGNORE NULLS) OVER (PARTITION BY flight, user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM s),
d AS (SELECT *, here::INTEGER - coalesce(lag(here) OVER w, false)::INTEGER AS dh, active::INTEGER - coalesce(lag(active) OVER w, false)::INTEGER AS da FROM p WINDOW w AS (PARTITION BY flight, user_id ORDER BY event_id))
SELECT flight, event_id, sum(dh) OVER w::BIGINT AS subscribers, sum(da) OVER w::BIGINT AS active, coalesce(bool_or(k = 'click' AND here) OVER w, false) AS current_priority,
  CASE WHEN sum(dh) OVER w = 0 THEN CASE WHEN k = 'error' AND dh < 0 THEN 'cancelled' ELSE 'idle' END WHEN sum(da) OVER w > 0 THEN 'running' ELSE 'paused' END AS gate FROM d WINDOW w AS (PARTITION BY flight ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def shared_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").select((F.col("user_id") % 20).alias("flight"), "user_id", "event_id", t.alias("k"))
    names = {"signup": "subscribe", "error": "leave", "purchase": "pause", "view": "resume", "click": "promote"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("k"))
    return S.shared_transfer(e.withColumn("kind", kind), "flight", "user_id", ["event_id"]).select("flight", "event_id", "subscribers", "active", "current_priority", "gate")


@query("""SELECT l_orderkey AS playlist, count(*) AS segments, least(greatest(max(l_quantity::BIGINT) * 500, 500), 5000) AS reload_ms, count(*) FILTER (l_tax > 0.06) AS gaps, bool_and(l_linestatus = 'F') AS ended FROM lineitem GROUP BY l_orderkey""")
def playlist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_tax", "l_linestatus")
    out = own.groupBy(F.col("l_orderkey").alias("playlist")).agg(F.count("*").alias("segments"), F.max(F.col("l_quantity").cast("long")).alias("t"), F.count_if(F.col("l_tax") > 0.06).alias("gaps"), F.bool_and(F.col("l_linestatus") == "F").alias("ended"))
    return out.select("playlist", "segments", N.reload_delay_ms(F.col("t")).alias("reload_ms"), "gaps", "ended")


@query("""SELECT event_id, samples * 1000 // rate AS ms, (samples * 48000 + rate - 1) // rate AS resampled, least(saturated, 9223372036854775807)::BIGINT AS saturated FROM
(SELECT event_id, event_id * 31 % 90000 AS samples, CASE WHEN event_id % 2 = 0 THEN 44100 ELSE 48000 END AS rate, 9223372036854770000::HUGEINT + event_id AS saturated FROM events)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    samples, rate = i * 31 % 90_000, F.when(i % 2 == 0, 44_100).otherwise(48_000)
    return read(spark, sf_dir, "events", "event_id").select(
        "event_id", N.duration_ms(samples, rate).alias("ms"), F.when(i % 2 == 0, A.resampled_length(samples, 44_100, 48_000)).otherwise(A.resampled_length(samples, 48_000, 48_000)).alias("resampled"),
        N.saturating_add(F.lit(9_223_372_036_854_770_000), i).alias("saturated"),
    )


# Folds: what a row does depends on what earlier rows gave, so no SQL stands beside them.


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id * 20 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS step, 1::BIGINT AS n, []::BIGINT[] AS q, NULL::BIGINT AS due, NULL::BIGINT AS cur, 0::BIGINT AS gone, true AS fresh, 0::BIGINT AS seq, 0::BIGINT AS rtp, 0::BIGINT AS media, NULL::BIGINT AS wall, false AS told,
  NULL::VARCHAR AS kind, 0::BIGINT AS o_seq, 0::BIGINT AS at_ms, 0::BIGINT AS o_media, 0::BIGINT AS o_rtp, false AS marker, 0::BIGINT AS late_ms FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT s.user_id, s.step + 1, s.n + (act IN ('take', 'ready'))::BIGINT,
  CASE WHEN act IN ('take', 'ready') THEN list_append(s.q, e.t) WHEN act = 'underrun' THEN s.q ELSE s.q[2:] END,
  CASE act WHEN 'underrun' THEN NULL WHEN 'sent' THEN CASE WHEN s.due + s.gone * 20 + 20 > a THEN s.due + s.gone * 20 + 20 ELSE a + 20 END WHEN 'ready' THEN e.t WHEN 'take' THEN CASE WHEN s.due IS NULL AND len(s.q) >= 4 THEN e.t ELSE s.due END ELSE s.due END,
  CASE WHEN act = 'dropped' THEN a END, CASE WHEN act = 'dropped' THEN s.gone + 1 ELSE 0 END, CASE act WHEN 'underrun' THEN true WHEN 'sent' THEN false ELSE s.fresh END, CASE WHEN act = 'sent' THEN (s.seq + 1) % 65536 ELSE s.seq END,
  CASE WHEN act = 'sent' THEN (r + 960) % 4294967296 WHEN act = 'dropped' THEN (s.rtp + 960) % 4294967296 ELSE s.rtp END, s.media + CASE WHEN act IN ('sent', 'dropped') THEN 20 ELSE 0 END, CASE WHEN act = 'sent' THEN a + 20 ELSE s.wall END, s.told OR act = 'ready',
  CASE act WHEN 'take' THEN NULL WHEN 'ready' THEN 'prebuffer_ready' ELSE act END, s.seq, CASE WHEN act = 'ready' THEN e.t WHEN act = 'underrun' THEN s.due ELSE a END, s.media, CASE WHEN act = 'sent' THEN r ELSE s.rtp END, act = 'sent' AND s.fresh,
  CASE WHEN act IN ('sent', 'dropped') THEN a - s.due ELSE 0 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n, LATERAL (SELECT coalesce(s.cur, greatest(s.due, s.q[1])) AS a) x,
  LATERAL (SELECT CASE WHEN s.due IS NULL OR s.due > e.t THEN CASE WHEN s.due IS NULL AND len(s.q) >= 4 AND NOT s.told THEN 'ready' ELSE 'take' END WHEN len(s.q) = 0 THEN 'underrun' WHEN a - s.due - s.gone * 20 > 100 AND len(s.q) > 1 THEN 'dropped' ELSE 'sent' END AS act,
    CASE WHEN s.fresh AND s.wall IS NOT NULL THEN (s.rtp + greatest(0, a - s.wall) * 48) % 4294967296 ELSE s.rtp END AS r) y)
SELECT user_id AS stream_id, o_seq AS seq, kind, at_ms, o_media AS position_ms, o_rtp AS rtp_timestamp, marker, late_ms FROM s WHERE kind IS NOT NULL""")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import folds

    e = read(spark, sf_dir, "events", "user_id", "event_id").select(F.col("user_id").alias("stream_id"), (F.col("event_id") * 20).alias("at_ms"), "event_id")
    return folds.fold(e, "stream_id", ["at_ms", "event_id"], folds.playout_step, folds.playout_start, folds.PLAYOUT)


@query("""WITH RECURSIVE e AS (SELECT event_id AS request, user_id % 16 AS stream_id, user_id % 50 AS item, user_id * 131071 + 1 AS size, (user_id * 131071 + 1048576) // 1048576 AS units, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS n FROM events),
q AS (SELECT stream_id, 0::BIGINT AS n, 0::BIGINT AS request, false AS hit, 0::BIGINT AS evicted, 0::BIGINT AS held_units, []::STRUCT(item BIGINT, size BIGINT, units BIGINT)[] AS l FROM (SELECT DISTINCT stream_id FROM e) UNION ALL
SELECT e.stream_id, e.n, e.request, x.hit, CASE WHEN x.at > 0 OR e.units > 64 THEN 0 ELSE x.gone END, coalesce(list_sum(list_transform(y.l, lambda z: z.units)), 0)::BIGINT, y.l FROM q JOIN e ON e.stream_id = q.stream_id AND e.n = q.n + 1,
  LATERAL (SELECT a.at, a.at > 0 AND q.l[greatest(a.at, 1)].size <= 16777216 AS hit,
    (SELECT min(g) FROM range(0, len(q.l) + 1) r(g) WHERE coalesce(list_sum(list_transform(q.l[g + 1:], lambda z: z.units)), 0) + e.units <= 64) AS gone FROM (SELECT coalesce(list_position(list_transform(q.l, lambda z: z.item), e.item), 0) AS at) a) x,
  LATERAL (SELECT CASE WHEN x.hit THEN list_append(list_concat(q.l[:x.at - 1], q.l[x.at + 1:]), q.l[x.at]) WHEN x.at > 0 OR e.units > 64 THEN q.l ELSE list_append(q.l[x.gone + 1:], {'item': e.item, 'size': e.size, 'units': e.units}) END AS l) y)
SELECT stream_id, request, hit, evicted, held_units FROM q WHERE n > 0""")
def source_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import folds

    e = read(spark, sf_dir, "events", "user_id", "event_id")
    e = e.select((F.col("user_id") % 16).alias("stream_id"), F.col("event_id").alias("request"), (F.col("user_id") % 50).alias("item"), (F.col("user_id") * 131_071 + 1).alias("size"), F.lit(16 << 20).alias("most"))
    return folds.fold(e, "stream_id", ["request"], folds.cache_step, folds.cache_start, folds.CACHE)


@query("""WITH RECURSIVE e AS (SELECT event_id AS request, user_id % 16 AS stream_id, user_id AS who, CASE WHEN event_id % 53 = 0 THEN 'drain' WHEN event_id % 501 = 0 THEN 'drainAll' WHEN event_type = 'view' THEN 'stateChanged' WHEN event_type = 'click' THEN 'networkQualityChanged' ELSE event_type END AS kind,
  row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS n FROM events),
q AS (SELECT stream_id, 0::BIGINT AS n, 0::BIGINT AS request, NULL::BIGINT AS dropped, []::STRUCT(request BIGINT, kind VARCHAR, who BIGINT)[] AS l, 0::BIGINT AS held FROM (SELECT DISTINCT stream_id FROM e) UNION ALL
SELECT e.stream_id, e.n, e.request, x.gone, x.l, CASE WHEN kind LIKE 'drain%' THEN len(q.l) - len(x.l) ELSE len(x.l) END FROM q JOIN e ON e.stream_id = q.stream_id AND e.n = q.n + 1,
  LATERAL (SELECT CASE WHEN kind LIKE 'drain%' THEN NULL WHEN same THEN len(q.l) WHEN len(q.l) >= 64 THEN CASE WHEN oldest > 0 THEN oldest ELSE 1 END END AS at
    FROM (SELECT coalesce(q.l[-1].kind = e.kind AND q.l[-1].who = e.who AND e.kind IN ('stateChanged', 'networkQualityChanged'), false) AS same, coalesce(list_position(list_transform(q.l, lambda y: y.kind IN ('stateChanged', 'networkQualityChanged')), true), 0) AS oldest)) w,
  LATERAL (SELECT CASE WHEN w.at IS NOT NULL THEN q.l[w.at].request END AS gone, CASE kind WHEN 'drainAll' THEN [] WHEN 'drain' THEN list_filter(q.l, lambda y: y.who <> e.who)
    ELSE list_append(CASE WHEN w.at IS NULL THEN q.l ELSE list_concat(q.l[:w.at - 1], q.l[w.at + 1:]) END, {'request': e.request, 'kind': kind, 'who': who}) END AS l) x)
SELECT stream_id, request, dropped, held FROM q WHERE n > 0""")
def event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import folds

    t, i = F.col("event_type"), F.col("event_id")
    kind = F.when(i % 53 == 0, "drain").when(i % 501 == 0, "drainAll").when(t == "view", "stateChanged").when(t == "click", "networkQualityChanged").otherwise(t)
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select((F.col("user_id") % 16).alias("stream_id"), i.alias("request"), kind.alias("kind"), F.col("user_id").alias("who"))
    return folds.fold(e, "stream_id", ["request"], folds.queue_step, lambda: folds.queue_start(64), folds.QUEUE)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, 't' || event_id % 5 AS cname, 'n' || event_id % 3 AS xname, CASE event_id % 2 WHEN 0 THEN 'SOURCE_AUTH_EXPIRED' ELSE 'DECODE_ERROR' END AS code,
  CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'play' WHEN 1 THEN 'ready' ELSE 'nextReady' END WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'pause' WHEN 1 THEN 'play' ELSE 'seek' END WHEN 'purchase' THEN 'ended' ELSE 'failed' END AS k FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS i, NULL::VARCHAR AS c, NULL::BIGINT AS cg, NULL::VARCHAR AS cl, 0::BIGINT AS ce, NULL::VARCHAR AS x, NULL::BIGINT AS xg, NULL::VARCHAR AS xl, 0::BIGINT AS xe, 'idle' AS state, 0::BIGINT AS made, 0::BIGINT AS version,
  ''::VARCHAR AS actions, ''::VARCHAR AS events, NULL::VARCHAR AS error FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT s.user_id, e.n, e.i, CASE WHEN fresh THEN cname WHEN prom THEN s.x WHEN gone THEN NULL ELSE s.c END, CASE WHEN instc THEN s.made + 1 WHEN prom THEN s.xg WHEN gone THEN NULL ELSE s.cg END,
  CASE WHEN instc THEN started WHEN prom OR la THEN 'starting' WHEN k = 'ready' AND s.c IS NOT NULL THEN 'ready' WHEN gone THEN NULL ELSE s.cl END,
  CASE WHEN instc THEN (NOT paused)::BIGINT WHEN prom THEN s.xe + 1 WHEN k = 'play' AND s.c IS NOT NULL THEN s.ce + la::BIGINT + armc::BIGINT WHEN stops AND s.cl = 'starting' THEN s.ce + 1 ELSE s.ce END,
  CASE WHEN instn THEN xname WHEN prom THEN NULL ELSE s.x END, CASE WHEN instn THEN s.made + 1 + fresh::BIGINT WHEN prom THEN NULL ELSE s.xg END,
  CASE WHEN instn THEN started WHEN prom THEN NULL WHEN ln THEN 'starting' WHEN k = 'nextReady' AND s.xl <> 'dormant' THEN 'ready' ELSE s.xl END,
  CASE WHEN instn THEN (NOT paused)::BIGINT WHEN ln OR armn OR stops AND s.xl = 'starting' THEN s.xe + 1 ELSE s.xe END,
  CASE WHEN instc OR prom THEN waits WHEN k = 'play' THEN CASE WHEN s.c IS NULL THEN CASE WHEN s.x IS NULL THEN 'idle' ELSE 'buffering' END WHEN paused AND s.cl = 'ready' THEN 'playing' WHEN s.state <> 'playing' THEN 'buffering' ELSE s.state END
    WHEN stops THEN 'paused' WHEN k = 'ready' AND s.c IS NOT NULL AND NOT paused THEN 'playing' WHEN gone THEN CASE WHEN s.x IS NULL THEN 'idle' ELSE waits END ELSE s.state END,
  s.made + instc::BIGINT + instn::BIGINT, CASE WHEN newer THEN e.i ELSE s.version END,
  concat_ws(';', CASE WHEN instc THEN CASE WHEN NOT paused THEN 'startCurrent(' || (s.made + 1) || ',1)' WHEN s.c IS NOT NULL THEN 'cancelCurrent(' || s.cg || ')' END END,
    CASE WHEN instn THEN CASE WHEN NOT paused THEN 'prepareNext(' || (s.made + 1 + fresh::BIGINT) || ',1)' WHEN NOT fresh AND s.x IS NOT NULL THEN 'cancelNext(' || s.xg || ')' END END,
    CASE WHEN k = 'failed' AND s.c IS NOT NULL THEN 'cancelCurrent(' || s.cg || ')' END, CASE WHEN prom THEN 'startCurrent(' || s.xg || ',' || (s.xe + 1) || ')' END,
    CASE WHEN la THEN 'startCurrent(' || s.cg || ',' || (s.ce + 1) || ')' END, CASE WHEN k = 'play' AND paused THEN CASE WHEN s.cl <> 'dormant' THEN 'resumeCurrent(' || s.cg || ')' WHEN s.c IS NULL AND s.xl <> 'dormant' THEN 'resumeNext(' || s.xg || ')' END END,
    CASE WHEN armc THEN 'armStartupDeadline(current,' || s.cg || ',' || (s.ce + la::BIGINT + 1) || ')' END, CASE WHEN armn THEN 'armStartupDeadline(next,' || s.xg || ',' || (s.xe + 1) || ')' END, CASE WHEN ln THEN 'prepareNext(' || s.xg || ',' || (s.xe + 1) || ')' END,
    CASE WHEN stops THEN CASE WHEN s.cl <> 'dormant' THEN 'pauseCurrent(' || s.cg || ')' WHEN s.xl <> 'dormant' THEN 'pauseNext(' || s.xg || ')' END END),
  CASE WHEN k = 'seek' AND s.c IS NULL THEN '' ELSE concat_ws(';', CASE WHEN k = 'failed' AND s.c IS NOT NULL THEN 'attemptFailed(' || s.c || ',' || code || ')' END, 'stateChanged',
    CASE WHEN k = 'failed' AND s.c IS NOT NULL AND code <> 'DECODE_ERROR' AND s.x IS NULL THEN 'sourceRefreshNeeded(current,' || s.c || ')' WHEN (gone OR k = 'play' AND s.c IS NULL) AND s.x IS NULL THEN 'nextNeeded' END) END,
  CASE WHEN k = 'seek' AND s.c IS NULL THEN 'UNSUPPORTED' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1, LATERAL (SELECT s.state = 'paused' AS paused, k = 'plan' AND e.i > s.version AS newer, CASE WHEN s.state = 'paused' THEN 'paused' ELSE 'buffering' END AS waits, CASE WHEN s.state = 'paused' THEN 'dormant' ELSE 'starting' END AS started,
    k = 'pause' AND s.state IN ('playing', 'buffering') AS stops, k = 'play' AND coalesce(s.cl = 'dormant', false) AND s.state <> 'playing' AS la, k = 'play' AND coalesce(s.xl = 'dormant', false) AS ln, k IN ('ended', 'failed') AND s.c IS NOT NULL AS over) a,
  LATERAL (SELECT newer AND s.c IS DISTINCT FROM cname AS fresh, coalesce(over AND s.xl = 'ready' OR k = 'nextReady' AND s.xl <> 'dormant' AND s.c IS NULL, false) AS prom) b,
  LATERAL (SELECT fresh OR k = 'seek' AND s.c IS NOT NULL AS instc, fresh OR newer AND s.x IS DISTINCT FROM xname AS instn, over AND NOT prom AS gone, k = 'play' AND paused AND (la OR coalesce(s.cl = 'starting', false)) AS armc, k = 'play' AND paused AND coalesce(s.xl = 'starting', false) AS armn) d)
SELECT user_id AS stream_id, i AS log_seq, state AS play_state, coalesce(cg, made) AS generation, version AS plan_version, c AS current, x AS next, actions, events, error FROM s WHERE n > 0""")
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import folds, session

    def step(s, row):
        i, kind = row["log_seq"], row["event_type"]
        name = {"id": f"t{i % 5}", "kind": "url", "seekable": True}
        now = s["current"]["generation"] if s["current"] else 0
        full = {
            "signup": {"kind": "plan", "plan_version": i, "current": name, "next": {"id": f"n{i % 3}", "kind": "url"}}, "view": {"kind": ("play", "prebufferReady", "nextReady")[i % 3]},
            "click": {"kind": ("pause", "play", "seek")[i % 3], "seek_s": i % 60}, "purchase": {"kind": "ended"}, "error": {"kind": "failed", "code": ("SOURCE_AUTH_EXPIRED", "DECODE_ERROR")[i % 2]},
        }[kind]
        then = s["next"]["generation"] if s["next"] else 0
        return session.session_step(s, {"log_seq": i, "generation": then if full["kind"] == "nextReady" else now, **full})

    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("log_seq"), "event_type")
    return folds.fold(e, "stream_id", ["log_seq"], step, session.session_start, session.SESSION)


@query("SELECT page_id, CASE WHEN url <> '' THEN true END AS same FROM pages")
def segment_decrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lit("0123456789abcdef").cast("binary")
    iv = F.when(F.col("page_id") % 2 == 0, F.lit("0x1234"))
    full = F.unhex(F.when(iv.isNotNull(), F.lpad(F.lit("1234"), 32, "0")).otherwise(F.lpad(F.hex("page_id"), 32, "0")))
    p = read(spark, sf_dir, "pages", "page_id", "url").withColumn("body", F.substring(F.aes_encrypt(F.col("url").cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), full), 17, 1 << 30))
    return p.select("page_id", (R.decrypt_segment(F.col("body"), key, iv, F.col("page_id")).cast("string") == F.col("url")).alias("same"))

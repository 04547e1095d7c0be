"""Queries over keys of shared transfers, reports and sample layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import numbers as N
from .catalogue import query, read


@query("""WITH k AS (SELECT event_id, user_id % 3 || ':' || event_type || ':' || event_id % 2 AS asked, user_id % 5 AS setting FROM events)
SELECT event_id, min(event_id) OVER (PARTITION BY asked, setting) AS leader FROM k""")
def flight_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of those with an equal flight key."""
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    headers = F.create_map(F.lit("a"), (F.col("event_id") % 2).cast("string"))
    key = C.flight_key((F.col("user_id") % 3).cast("string"), F.concat(F.lit("https://h/"), "event_type"), headers, F.lit("provider"), F.lit(100), F.col("user_id") % 5)
    keyed = e.select("event_id", key.alias("flight"))
    # Few requests lead; the others look their leader up.
    first = keyed.groupBy("flight").agg(F.min("event_id").alias("leader"))
    return keyed.join(first, "flight").select("event_id", "leader")


@query("""SELECT event_id, (event_id * 7919 % 4294967296 + greatest(event_id % 50 * 1000 - 5000, 0) * 48000 // 1000000) % 4294967296 AS rtp_time, least(event_id * 900000007, 4294967295) AS packets,
  event_id * 37 % 256 * 100.0::DOUBLE / 256 AS loss_percent, event_id * 13 % 1000 / 1000.0::DOUBLE AS jitter_ms, CASE WHEN event_id % 3 > 0 THEN event_id * 7 / 1000.0::DOUBLE END AS rtt_ms FROM events WHERE event_id % 9 > 0""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as they are sent and handed out; those of another source aren't."""
    i = F.col("event_id")
    e = read(spark, sf_dir, "events", "event_id").where(i % 9 > 0)
    report = N.report_percent_ms(i * 37 % 256, i * 13 % 1000, F.when(i % 3 > 0, i * 7))
    out = e.select("event_id", N.projected_rtp(N.wrap(i * 7919), F.lit(5000), i % 50 * 1000).alias("rtp_time"), N.capped_u32(i * 900_000_007).alias("packets"), report.alias("r"))
    return out.select("event_id", "rtp_time", "packets", "r.*")


@query("""SELECT vec_id, list_transform(range(0, 2 * len(embedding)), lambda i: embedding[i // 2 + 1]::DOUBLE) AS stereo, list_transform(embedding[2 * least(vec_id % 40, 32) + 1:2 * greatest(least(vec_id % 40, 32), 32 - vec_id % 7)], lambda x: x::DOUBLE) AS trimmed,
  list_transform(embedding, lambda x: CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN x::DOUBLE ELSE round(greatest(least(x::DOUBLE * 3, 1), -1), 9) END) AS loud FROM embeddings""")
def pcm_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono to stereo, packet trim of two channels, and volumes without the limiter."""
    from ..functions import arrays as A

    s, i = F.col("embedding"), F.col("vec_id")
    gain = F.when(i % 3 == 0, 0.0).when(i % 3 == 1, 1.0).otherwise(3.0)
    whole = lambda c: F.transform(c, lambda x: x.cast("double"))
    loud = F.transform(A.apply_volume(s, gain, limiter=False), lambda x: F.when(i % 3 == 2, N.rounded(x, 9)).otherwise(x))
    return read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", whole(A.mono_to_stereo(s)).alias("stereo"), whole(A.trim(s, 2, i % 40, i % 7)).alias("trimmed"), loud.alias("loud"))

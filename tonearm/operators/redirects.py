"""Chains of redirects over a table of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .playlists import url_join
from .scans import written

#: Fixed value: addresses that a request may have been at before a redirect is refused.
MOST_VISITED = 10


def followed(requests: DataFrame, hops: DataFrame, id_: str = "id") -> DataFrame:
    """id, url, hops, error of each request (id, url, public_only) over hops (url, location): where it ends.

    A location may be relative.  Every address of a public-only request must be one it may have; a request that has been at
    MOST_VISITED addresses and is sent on fails, so cycles end.  Equal requests are followed once; of a url's hops the
    smallest location counts; an address without a location is an end."""
    known = hops.where("location IS NOT NULL").groupBy(F.col("url").alias("_at")).agg(F.min("location").alias("_location"))
    # Where a hop leads, and who may go there, is worked out once a hop.
    known = written(known.select("_at", url_join(F.col("_at"), F.col("_location")).alias("_target")))
    known = written(known.select("_at", "_target", R.url_policy(F.col("_target"), True).alias("_not_public"), R.url_policy(F.col("_target")).alias("_not_any")))
    start = requests.select(F.col("url").alias("_start"), F.coalesce("public_only", F.lit(False)).alias("_public")).distinct()
    now = start.select("_start", "_public", F.col("_start").alias("_now"), F.lit(0).alias("hops"), F.when(F.col("_public"), R.url_policy(F.col("_start"), True)).otherwise(R.url_policy(F.col("_start"))).alias("error"))
    now = written(now.withColumn("_open", F.col("error").isNull()))
    for visited in range(1, MOST_VISITED + 1):
        if now.where("_open").isEmpty():
            break
        met = now.join(known, F.col("_now") == F.col("_at"), "left")
        met = met.withColumn("_goes", F.col("_open") & F.col("_target").isNotNull())
        refused = F.lit("INVALID_SOURCE") if visited == MOST_VISITED else F.when(F.col("_public"), F.col("_not_public")).otherwise(F.col("_not_any"))
        met = met.withColumn("_refused", F.when(F.col("_goes"), refused))
        on = F.col("_goes") & F.col("_refused").isNull()
        now = met.select(
            "_start", "_public", F.when(on, F.col("_target")).otherwise(F.col("_now")).alias("_now"), (F.col("hops") + on.cast("int")).alias("hops"),
            F.coalesce("error", "_refused").alias("error"), on.alias("_open"),
        )
        now = written(now)
    asked = requests.select(F.col(id_), F.col("url").alias("_u"), F.coalesce("public_only", F.lit(False)).alias("_p"))
    out = asked.join(now, F.col("_u").eqNullSafe(F.col("_start")) & (F.col("_p") == F.col("_public")))
    return out.select(id_, F.when(F.col("error").isNull(), F.col("_now")).alias("url"), "hops", "error")

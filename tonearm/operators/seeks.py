"""Requests for spans of sound against tables of chunks: only what was asked for is read.

Chunks are placed along their stream and dealt by bins of frames, and so are the requests; a pair meets in the first bin that both
have.  Chunks in no requested bin are dropped where they lie, by a filter whose size is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .scans import scan

#: Frames of a bin, and the most rows of a filter of bins.
BIN, SLOTS = 1 << 14, 1 << 19


def placed(chunks: DataFrame, key: str, order: list[str], channels: int = 1, column: str = "samples", buckets: int | None = None) -> DataFrame:
    """The chunks with first_frame and n_frames, by the frames before them; of streams of any length."""
    n = F.when(F.size(column) > 0, N.idiv(F.size(column).cast("long"), channels)).otherwise(F.lit(0).cast("long"))
    out = scan(chunks.withColumn("n_frames", n), [key], order, sums={"_to": F.col("n_frames")}, buckets=buckets)
    return out.withColumn("first_frame", F.col("_to") - F.col("n_frames")).drop("_to")


def bins(first: Column, end: Column, width: int) -> Column:
    return F.sequence(N.idiv(first, width), N.idiv(end - 1, width))


def seek(requests: DataFrame, chunks: DataFrame, key: str, id_: str = "id", channels: int = 1, column: str = "samples", width: int = BIN) -> DataFrame:
    """id, key, first_frame, n_frames and samples of each request (id, key, at_ms, n_frames) for so many frames from a time on.

    Chunks have first_frame, n_frames, sample_rate and samples.  The time is met to the frame; what lies past the end isn't
    there, and a request that meets nothing has 0 frames and no samples.  Ids must be unique."""
    rate = chunks.groupBy(key).agg(F.max("sample_rate").alias("_rate"))
    asked = requests.join(rate, key, "left").withColumn("_from", F.call_function("div", F.col("at_ms").cast("long") * F.col("_rate"), F.lit(1000)))
    asked = asked.select(F.col(id_), F.col(key), "_from", (F.col("_from") + F.col("n_frames")).alias("_end"))
    wanted = asked.where("_end > _from AND _from >= 0").withColumn("_bin", F.explode(bins(F.col("_from"), F.col("_end"), width)))
    slot = lambda k: F.pmod(F.xxhash64(k, F.col("_bin")), F.lit(SLOTS)).cast("int")
    hit = F.broadcast(wanted.select(slot(F.col(key)).alias("_slot")).distinct())
    own = chunks.where("n_frames > 0").select(F.col(key).alias("_key"), F.col("first_frame").alias("_at"), F.col("n_frames").alias("_n"), F.col(column).alias("_x"))
    own = own.withColumn("_bin", F.explode(bins(F.col("_at"), F.col("_at") + F.col("_n"), width))).withColumn("_s", slot(F.col("_key")))
    own = own.join(hit, F.col("_s") == F.col("_slot"), "left_semi").withColumnRenamed("_bin", "_b")
    met = wanted.join(own, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_b")))
    low, high = F.greatest("_from", "_at"), F.least(F.col("_end"), F.col("_at") + F.col("_n"))
    # Once for a pair: in the bin where the later of both begins.
    met = met.where((low < high) & (F.col("_bin") == N.idiv(low, width)))
    cut = F.slice("_x", ((low - F.col("_at")) * channels + 1).cast("int"), ((high - low) * channels).cast("int"))
    pieces = met.select(id_, low.alias("_low"), cut.alias("_cut")).groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("_low", "_cut"))).alias("_p"))  # a request's own
    out = asked.join(pieces, id_, "left")
    samples = F.coalesce(F.flatten(F.transform("_p", lambda p: p["_cut"])), F.array().cast(chunks.schema[column].dataType))
    return out.select(id_, key, F.col("_from").alias("first_frame"), samples.alias("samples")).withColumn("n_frames", N.idiv(F.size("samples").cast("long"), channels))

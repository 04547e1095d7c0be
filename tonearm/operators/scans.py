"""Scans along streams of any length: running sums, last values, values before, maxima before.

A window over a stream sorts it in one task.  Here the rows are dealt by ranges of (key, order) into buckets of bounded size, so
one stream may lie in many; each bucket is scanned by itself, buckets' partials are scanned in turn (a row a bucket), and what
comes before a bucket is joined back.  Between two buckets at most one stream goes on, so there are fewer carries than buckets
and they may be broadcast.

Orders must be total (end in a unique column); nulls come first.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket; there are as many buckets as shuffle partitions at least.
ROWS = 1 << 20


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that what they were dealt by stays as it is."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not place and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="tonearm-scans-"))
    return df.checkpoint(eager=True)


def scan(
    df: DataFrame, key: list[str], order: list[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None,
    befores: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, buckets: int | None = None,
) -> DataFrame:
    """``df`` with columns named by what is asked for, along each stream:

    ``sums``: the sum up to the row, its own included (null while there is none); ``lasts``: the last non-null value up to the
    row, its own included; ``befores``: the value of the row before; ``maxima``: the largest of the rows before."""
    asked = {n: (kind, c) for kind, own in (("sum", sums), ("last", lasts), ("before", befores), ("max", maxima)) for n, c in (own or {}).items()}
    at = {n: f"_v{i}" for i, n in enumerate(asked)}
    if buckets is None:
        buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    kept = [c for c in df.columns if c not in asked]
    own = df.select(*[df[c] for c in kept], *[c.alias(at[n]) for n, (_, c) in asked.items()])
    own = written(own.repartitionByRange(buckets, *key, *order).withColumn("_bucket", F.spark_partition_id()))
    # Each bucket by itself: one order serves all windows.
    w = Window.partitionBy(*key, "_bucket").orderBy(*order)
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = {"sum": lambda c: F.sum(c).over(so_far), "last": lambda c: F.last(c, ignorenulls=True).over(so_far), "before": lambda c: F.lag(c).over(w), "max": lambda c: F.max(c).over(earlier)}
    # The buckets' partials, and what comes before each.
    place = F.struct(*order)
    whole = {"sum": F.sum, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)), "before": lambda c: F.max_by(F.struct(F.col(c).alias("x")), place), "max": F.max}
    by = Window.partitionBy(*key).orderBy("_bucket")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"sum": lambda c: F.sum(c).over(past), "last": lambda c: F.last(c, ignorenulls=True).over(past), "before": lambda c: F.lag(c).over(by), "max": lambda c: F.max(c).over(past)}
    partial = own.groupBy(*key, "_bucket").agg(*[whole[kind](at[n]).alias(at[n]) for n, (kind, _) in asked.items()])
    carries = partial.select(*key, "_bucket", *[carry[kind](at[n]).alias(f"{at[n]}c") for n, (kind, _) in asked.items()], F.row_number().over(by).alias("_nth")).where("_nth > 1").drop("_nth")
    names = [f"_k{i}" for i in range(len(key))]
    carries = F.broadcast(carries.select(*[F.col(k).alias(x) for k, x in zip(key, names, strict=True)], F.col("_bucket").alias("_b"), *[f"{at[n]}c" for n in asked]))
    scanned = own.withColumns({f"{at[n]}l": local[kind](at[n]) for n, (kind, _) in asked.items()} | {"_first": F.row_number().over(w) == 1})
    same = scanned["_bucket"] == F.col("_b")
    for k, x in zip(key, names, strict=True):
        same &= scanned[k].eqNullSafe(F.col(x))
    out = scanned.join(carries, same, "left")

    def together(n: str, kind: str) -> Column:
        here, past = F.col(f"{at[n]}l"), F.col(f"{at[n]}c")
        if kind == "sum":
            return F.coalesce(here + past, here, past)
        if kind == "last":
            return F.coalesce(here, past)
        return F.greatest(here, past) if kind == "max" else F.when(F.col("_first"), past["x"]).otherwise(here)

    return out.select(*[F.col(f"`{c}`") for c in kept], *[together(n, kind).alias(n) for n, (kind, _) in asked.items()])

"""From a request to its first packet: the stages of each attempt, and sketches of their lengths that add up over days.

Workers' marks name a stream and not an attempt, so a mark belongs to the attempt that is the stream's as of its time.  A stage ends
at the first mark of its kind that isn't before the end of the stage before, so an attempt's time is the sum of its stages.

A sketch counts values by logarithmic buckets: any quantile is within ERROR of a value of that rank, relatively, and sketches of
parts of the data add up to that of the whole.  It has as many rows as buckets that occur: under a thousand up to 2^63.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import scan

REQUEST = "request"
#: The stages in order, by the mark that ends each.
STAGES = {"admission": "admitted", "open": "opened", "probe": "probed", "prebuffer": "prebuffered", "send": "sent"}
ERROR = 0.01
GROWTH = (1 + ERROR) / (1 - ERROR)


def first_packets(log: DataFrame, key: str, order: list[str], at: str, mark: str, buckets: int | None = None) -> DataFrame:
    """The requests of a log of marks with the length of each stage that has ended (null otherwise), and total_ms."""
    asked = F.when(F.col(mark) == REQUEST, F.struct(*order))
    own = scan(log, [key], order, lasts={"_attempt": asked}, buckets=buckets).where("_attempt IS NOT NULL")
    w = Window.partitionBy(key, "_attempt")
    own = own.withColumn("_t0", F.min(F.when(F.col(mark) == REQUEST, F.col(at))).over(w))
    for i, end in enumerate(STAGES.values()):
        own = own.withColumn(f"_t{i + 1}", F.min(F.when((F.col(mark) == end) & (F.col(at) >= F.col(f"_t{i}")), F.col(at))).over(w))
    lengths = {f"{s}_ms": F.col(f"_t{i + 1}") - F.col(f"_t{i}") for i, s in enumerate(STAGES)}
    out = own.where(F.col(mark) == REQUEST).withColumns(lengths | {"total_ms": F.col(f"_t{len(STAGES)}") - F.col("_t0")})
    return out.drop("_attempt", *[f"_t{i}" for i in range(len(STAGES) + 1)])


def bucket(x: Column) -> Column:
    """The bucket of a value: null for 0 and less, which count as 0."""
    return F.when(x > 0, F.ceil(F.log(x.cast("double")) / F.lit(math.log(GROWTH))).cast("int"))


def sketch(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The counts of each group's values by bucket; nulls don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """count and the quantile of each share: of the value at rank ceil(share * count), one of its bucket's."""
    w = Window.partitionBy(*by)
    so_far = F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    own = sketches.withColumns({"_to": so_far, "_n": F.sum("n").over(w)})
    middle = F.coalesce(F.pow(F.lit(GROWTH), F.col("bucket")) * (2 / (GROWTH + 1)), F.lit(0.0))
    at = lambda p: F.greatest(F.ceil(F.col("_n") * F.lit(p)), F.lit(1))
    inside = lambda p: (at(p) <= F.col("_to")) & (at(p) > F.col("_to") - F.col("n"))
    return own.groupBy(*by).agg(F.sum("n").alias("count"), *[F.max(F.when(inside(p), middle)).alias(name) for name, p in shares.items()])

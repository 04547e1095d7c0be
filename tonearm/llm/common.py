"""What the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a record batch that goes to a Python worker; Spark's own default is 64 MB, held by either side.
BATCH_BYTES, _SETTING, _DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's record batches, unless the caller has set a size."""
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; only where none is set (local tests) makes one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not place and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="tonearm-checkpoint-"))


def materialized(df: DataFrame) -> DataFrame:
    """Cuts the lineage at files in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds few bytes (or a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of every slice, one slice after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: The most rows of a filter of hash slots.
SLOTS = 1 << 19


def slot(id_: Column, level: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), id_), F.lit(SLOTS)).cast("int")


def slots(ids: DataFrame, column: str, level: int = 0) -> DataFrame:
    """The hash slots that ids fall in: at most SLOTS rows, so they may be broadcast whatever their number."""
    return F.broadcast(ids.select(slot(F.col(column), level).alias("slot")).distinct())


def without(rows: DataFrame, ids: DataFrame, lost: DataFrame) -> DataFrame:
    """``rows`` (uid and more) but those of the uids in ``lost``; ``ids``: the uids of all rows.

    Three filters of hash slots settle nearly every row where it lies: in no slot of a lost uid, it stays; in none of
    the kept uids that share a slot with a lost one, it goes; in none of the lost uids that share one with those, it
    stays.  The rest meets the lost uids in a join, so the result is exact."""

    def met(df: DataFrame, by: DataFrame, level: int, how: str) -> DataFrame:
        return df.join(slots(by, "uid", level), slot(df["uid"], level) == F.col("slot"), how)

    mixed = materialized(met(ids, lost, 0, "left_semi").join(lost, "uid", "left_anti"))
    again = materialized(met(lost, mixed, 1, "left_semi"))
    sure = met(rows, lost, 0, "left_anti")
    unsure = met(met(rows, lost, 0, "left_semi"), mixed, 1, "left_semi")
    rest = met(unsure, again, 2, "left_semi").join(lost, "uid", "left_anti")
    return sure.unionByName(met(unsure, again, 2, "left_anti")).unionByName(rest)


def packed(x: np.ndarray) -> bytes:
    """uint32 values by planes of bytes, so that the planes of zeros compress away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written to the shared storage."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

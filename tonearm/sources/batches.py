"""Record batches of rows of bytes, cut small: what a Python worker holds follows neither the table nor the size of its batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of a piece, and of the batches that are sent; Spark's own default is 64 MB, held by either side several times over.
BYTES, _SETTING, _DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's record batches, unless the caller has set a size."""
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, str(BYTES))


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Every row, in batches whose ``column`` (bytes, text or lists of numbers) holds less than ``most`` bytes, or one row more."""
    for batch in batches:
        own = batch.column(column)
        lists = pa.types.is_list(own.type) or pa.types.is_large_list(own.type)
        lengths = pc.multiply(pc.cast(pc.list_value_length(own), pa.int64()), 8) if lists else pc.cast(pc.binary_length(own), pa.int64())
        part = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)

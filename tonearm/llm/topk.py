"""Exact top-k inner products over norm-sorted vectors (operator 4).

Candidates are range-partitioned by descending length (ties by id, so equal
vectors spread) and each partition is read in that order.  The longest of all
(a bounded block) give every query a first threshold.  A query is dealt to the
partitions whose longest vector could reach its threshold, all in one exchange;
there it meets the candidates in blocks and is left out as soon as |q| * |x|
cannot reach its threshold.  For the others the vectors are rotated by the
eigenvectors of the whole table's Gram matrix (the right singular vectors), and
the dot product of the leading coordinates plus the product of the residual
lengths (Cauchy-Schwarz) bounds the score.  What remains is scored exactly in
integers.  Queries are never gathered by the driver.

Defined results: a vector that is null or holds a null or non-finite component
takes no part, and so do rows with a null id; every finite component counts,
those whose squares leave the doubles without pruning; a zero-length vector
scores 0; only vectors of equal dimension are compared; a row never meets rows
with its own id; a repeated query id is asked once per distinct vector; scores
beyond 64 bits are held at the limits; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized, pieces

SCALE = 1024
#: Queries that a task holds at once, and candidates that they meet at once.
QUERY_BLOCK, BLOCK = 1024, 2048
#: Candidates of a partition on average, and their bytes at most, which a task holds.
PART_ROWS, PART_BYTES = 65_536, 32 << 20
HEAD = 4096
#: Dimensions that are rotated: so many of the commonest, and none wider.
TURNED, WIDEST = 16, 1024
_EXACT = 1 << 53
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantized(df: DataFrame) -> DataFrame:
    """vec_id, v (the floored components over SCALE as doubles, which hold them exactly), norm, dim."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # floor() would go through a long; c - pmod(c, 1) is exact in doubles of any size.  Large ones are whole, and stay.
    v = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**52, (c * float(SCALE) - F.pmod(c * float(SCALE), F.lit(1.0))) / float(SCALE)).otherwise(c))
    df = df.select(df["vec_id"].cast("long").alias("vec_id"), "embedding").where(good).select("vec_id", v.alias("v"))
    return df.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).withColumn("dim", F.size("v"))


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows that are over SCALE; as int64, held at its limits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * SCALE * float(np.abs(x).max()) * SCALE * q.shape[1] < _EXACT:
        return ((q * SCALE) @ (x * SCALE).T).astype(np.int64)  # every partial sum is an integer that a double holds
    big = lambda a: np.array([[int(c) * SCALE if abs(c) >= 2**52 else int(c * SCALE) for c in row] for row in a], dtype=object)
    return np.clip(big(q) @ big(x).T, _LOW, _HIGH).astype(np.int64)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def gram(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The Gram matrix of the commonest dimensions: partial sums per task, added up by Spark (dim squared cells)."""
    turned = [r["dim"] for r in vectors.where(F.col("dim").between(1, WIDEST)).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(TURNED).collect()]
    vectors = vectors.where(F.col("dim").isin(turned) & (F.col("norm") < float("inf")))
    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("x", pa.float64())])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                if d:
                    m = _matrix(batch.filter(pa.array(dims == d)).column("v"), int(d))
                    m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
                    sums[int(d)] = sums.get(int(d), 0) + m.T @ m
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(m.ravel())], schema=schema)

    rows = vectors.select("v", "dim").mapInArrow(run, "dim int, cell int, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for d, own in rows.groupby("dim"):
        m = np.zeros(d * d)
        m[own["cell"].to_numpy()] = own["x"].to_numpy()
        out[int(d)] = m.reshape(d, d)
    return out


def rotation(m: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the direction with the most energy first."""
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


class Block:
    """A bounded block of queries of one dimension and their best so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray | None, k: int, lead: int):
        self.ids, self.q, self.turn, self.k, self.lead = ids, q, turn, k, lead
        self.norm, self.front, self.rest = self.parts(q)
        self.score = np.full((len(ids), k), _LOW, np.int64)
        self.found = np.full((len(ids), k), _HIGH, np.int64)
        self.full = np.zeros(len(ids), np.int64)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths (in units of the scores; infinite for what can't be pruned), leading coordinates and residual lengths."""
        with np.errstate(over="ignore", invalid="ignore"):
            x = x * SCALE
            norm = np.sqrt((x * x).sum(1))
            safe = np.where((norm < 1e140)[:, None], x, 0)
            r = safe if self.turn is None else safe @ self.turn
            return np.where(norm < 1e140, norm, np.inf), r[:, : self.lead], np.sqrt((r[:, self.lead :] ** 2).sum(1))

    def threshold(self) -> np.ndarray:
        """The k-th best score; minus infinity while there are fewer, or while it is at the limit."""
        last = self.score[:, -1]
        return np.where((self.full >= self.k) & (last > _LOW), last.astype(np.float64), -np.inf)

    def offer(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray | None = None) -> None:
        """Candidates in descending length.  floor: scores that some k candidates are known to reach."""
        if not len(ids) or not len(self.ids):
            return
        at = self.threshold() if floor is None else np.maximum(self.threshold(), floor)
        norm, front, rest = self.parts(x)
        free, most = np.isinf(self.norm), norm.max()
        with np.errstate(invalid="ignore"):
            slack = 0.25 + 1e-9 * self.norm * most  # more than rounding can take away
            open_ = np.flatnonzero(free | np.isinf(most) | (self.norm * most + slack >= at))
        for part in np.array_split(open_, -(-len(open_) // 512)) if len(open_) else ():
            with np.errstate(invalid="ignore"):
                bound = self.front[part] @ front.T + np.outer(self.rest[part], rest)
                near = (bound + slack[part, None] >= at[part, None]) | free[part, None] | np.isinf(norm)[None, :]
            use = near.any(0)
            if not use.any():
                continue
            score = dots(self.q[part], x[use])
            near = near[:, use] & (ids[use][None, :] != self.ids[part, None])
            for row, mask, s in zip(part, near, score, strict=True):
                if mask.any():
                    self._merge(row, s[mask], ids[use][mask])

    def _merge(self, row: int, score: np.ndarray, ids: np.ndarray) -> None:
        n = int(self.full[row])
        if len(score) > self.k:
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            if (score == cut).sum() <= 4 * self.k:
                keep = score >= cut
                score, ids = score[keep], ids[keep]
        s, i = np.concatenate([self.score[row, :n], score]), np.concatenate([self.found[row, :n], ids])
        best = np.lexsort((i, ~s))[: self.k]  # ~s descends as s, without overflow
        m = self.full[row] = len(best)
        self.score[row, :m], self.found[row, :m] = s[best], i[best]


def by_dim(batch: pa.RecordBatch):
    """The rows of each dimension of a batch: the dimension, the rows and their vectors."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        own = batch.filter(pa.array(dims == d))
        yield d, own, _matrix(own.column("v"), d)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, lead_share: float = 0.25) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates of ``vectors``; ties to the smaller id."""
    spark = vectors.sparkSession
    base = materialized(quantized(vectors))
    turns = {d: rotation(m) for d, m in gram(base).items()}
    lead = lambda d: max(1, int(d * lead_share))
    rows, width = base.agg(F.count("*"), F.sum("dim")).first()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS + 1, 8 * (width or 0) // PART_BYTES + 1)
    dealt = base.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    dealt = materialized(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    # The longest vectors of all: a bounded block.
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d, own, x in (y for b in dealt.orderBy("place").limit(HEAD).select("vec_id", "v", "dim").toArrow().combine_chunks().to_batches() for y in by_dim(b)):
        heads[d] = own.column("vec_id").to_numpy(), x
    model = spark.sparkContext.broadcast((turns, heads))
    asked = quantized(queries).dropDuplicates(["vec_id", "v"])
    asked = asked.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v", "norm", "dim")

    def begin(batches):
        turned, longest = model.value
        for batch in pieces(batches, 1 << 20):
            for d, own, q in by_dim(batch):
                block = Block(own.column("vec_id").to_numpy(), q, turned.get(d), k, lead(d))
                for at in range(0, len(longest[d][0]) if d in longest else 0, BLOCK):
                    block.offer(longest[d][0][at : at + BLOCK], longest[d][1][at : at + BLOCK])
                yield own.append_column("floor", pa.array(block.threshold()))

    asked = materialized(asked.mapInArrow(begin, "uid long, vec_id long, v array<double>, norm double, dim int, floor double"))
    # By part and dimension the longest vector; Cauchy-Schwarz tells where a query has to go.
    longest = dealt.groupBy("part", "dim").agg(F.max("norm").alias("most"))
    product = F.col("norm") * F.col("most") * float(SCALE * SCALE)
    goes = product.isNull() | F.isnan(product) | (product * (1 + 1e-9) + 0.25 >= F.col("floor"))
    ways = longest.groupBy("dim").agg(F.collect_list(F.struct("part", "most")).alias("ways"))  # a row a part
    sent = asked.join(F.broadcast(ways), "dim").select("uid", "vec_id", "v", "norm", "dim", "floor", F.explode("ways").alias("way"))
    sent = sent.select("way.part", F.lit(1).alias("kind"), F.col("uid").alias("place"), "vec_id", "v", "dim", "floor", "norm", F.col("way.most").alias("most")).where(goes).drop("norm", "most")
    both = dealt.select("part", F.lit(0).alias("kind"), "place", "vec_id", "v", "dim", F.lit(None).cast("double").alias("floor")).unionByName(sent)
    met = both.repartition(parts, "part").sortWithinPartitions("part", "kind", "place")
    schema = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answers(own: list[pa.RecordBatch], mine: dict[int, list]):
        for d, rows, q in (y for b in pa.Table.from_batches(own).combine_chunks().to_batches() for y in by_dim(b)):
            block = Block(rows.column("vec_id").to_numpy(), q, model.value[0].get(d), k, lead(d))
            floor = rows.column("floor").to_numpy()
            for ids, x in mine.get(d, ()):
                for at in range(0, len(ids), BLOCK):
                    block.offer(ids[at : at + BLOCK], x[at : at + BLOCK], floor)
            use = np.arange(k)[None, :] < block.full[:, None]
            n = use.sum(1)
            if n.any():
                uid = rows.column("place").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uid, n)), pa.array(np.repeat(block.ids, n)), pa.array(block.found[use]), pa.array(block.score[use])], schema=schema)

    def run(batches):
        now, mine, held = -1, {}, []  # of the part at hand: its candidates by dimension, and queries that wait
        for batch in batches:
            part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            edge = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]))[: len(part)]).tolist()
            for i, j in zip(edge, [*edge[1:], len(part)], strict=True):
                if part[i] != now:
                    yield from answers(held, mine) if held else ()
                    now, mine, held = part[i], {}, []
                if kind[i] == 0:
                    for d, own, x in by_dim(batch.slice(i, j - i)):
                        mine.setdefault(d, []).append((own.column("vec_id").to_numpy(), x))
                    continue
                for at in range(i, j, QUERY_BLOCK):
                    held.append(batch.slice(at, min(QUERY_BLOCK, j - at)))
                    if sum(x.num_rows for x in held) >= QUERY_BLOCK:
                        yield from answers(held, mine)
                        held = []
        yield from answers(held, mine) if held else ()

    found = met.mapInArrow(run, "uid long, query_id long, vec_id long, score long")
    # At most k rows of each query from each part.
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

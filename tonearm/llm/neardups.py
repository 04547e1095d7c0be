"""Near-duplicate removal for the pipeline (operator 6, verified).

Documents are near-duplicates where the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more, and so on from document to document.
Candidates come two ways and are verified exactly:

- SimHash fingerprints of the shingles that the deletion variants of
  ``simhash.links`` tie together;
- a prefix filter, since fingerprints within few bits lose pairs.  Shingles
  have one order for all documents.  Two sets with similarity s share a shingle
  among the first n - ceil(s * n) + 1 of each, whatever the order is, so those
  are keys, and no pair is lost.  The order only decides how many documents
  without a near copy share a key: shingles are counted over all texts, those of
  few texts come first, and so a passage that many documents hold makes no keys
  of theirs.

The counts are told by a map of constant size, which is broadcast; at any size
of corpus it knows the commonest shingles that fit into it.  The others tie texts
by chance, the more of them the larger the corpus, until most texts are one
component.  So the texts of a component that is too large for one task get their
links anew: every two texts that share a key, but those whose sketches of parity
bits rule the similarity out.  Sketches differ in no more bits than the sets do
in shingles, so no pair is lost.

Rows are told apart by 128-bit digests of their content and not by their place
in a scan, so that it doesn't matter how often or in what splits they are read.

Defined results: a null text counts as empty; texts with equal characters are
one text, of which the row with the smallest doc_id (null last) stays, and of
rows equal in every column one; texts without words are only ever duplicates of
equal texts; a text of fewer than five words has itself as its only shingle;
texts of any length are compared whole; extra columns of any name pass through;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, packed, pieces, ragged, slot, slots, texts_of, unpacked, without
from .simhash import components, fingerprint, links, shingle_hashes, whole_groups

WIDTH, LEAST = 5, 0.8
#: Slots of the map of common shingles: what is broadcast is half of it in bytes, at any size of corpus.
MAP_SLOTS = 1 << 25
#: Bytes of text that a task compares at once, twice.
BLOCK_BYTES = 6 << 20
#: Bytes of text whose keys are met in one group.
GROUP_BYTES = 3_000_000
#: Texts that share a key are tied in pairs; where there are more of them, all to the first.
PAIRED = 16
#: Keys that two texts of a large component must have in common; sets too small for that count each key as so many.
SHARED = 3
#: Bits of the filter that tells which texts get their links anew.
FILTER_BITS = 1 << 26
_HELD = 1_000_000
_LOW32 = np.uint64(0xFFFFFFFF)


def group_of(h: np.ndarray, many: int) -> np.ndarray:
    """The group, below ``many``, of each 64-bit hash, by its upper half."""
    return (h >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of a sorted array start and end."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return first, np.append(first[1:], len(x))[: len(first)]


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the sums of their counts."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first, _ = runs(values)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def frequency_map(texts: DataFrame, width: int, many: int, parts: int) -> np.ndarray:
    """For each slot of a shingle's hash, two to a byte, the binary logarithm of how many texts its commonest shingle is in.

    Each of ``many`` groups of hashes has the same number of slots.  Shingles of a single text are not entered, nor the
    rarest of the others where those would fill over a quarter of the slots.  The driver gets the map alone (MAP_SLOTS / 2
    bytes)."""
    size = slots_of(many)
    schema = pa.schema([("part", pa.int64()), ("value", pa.binary()), ("n", pa.binary())])

    def out(code: np.ndarray, n: np.ndarray):
        part, value = code >> np.uint64(32), code & _LOW32
        rows = []
        for a, b in zip(*(x.tolist() for x in runs(part)), strict=True):
            rows.append((int(part[a]), packed(np.diff(value[a:b], prepend=np.uint64(0))), packed(n[a:b] - 1)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def count(batches):
        code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in pieces(batches, 4 << 20):
            h = np.concatenate([np.unique(shingle_hashes(x, width)) for x in texts_of(batch)])
            new = group_of(h, many) << np.uint64(32) | cell_of(h)
            code, n = summed(np.concatenate([code, new]), np.concatenate([n, np.ones(len(new), np.int64)]))
            if len(code) > _HELD:
                yield from out(code, n)
                code, n = code[:0], n[:0]
        yield from out(code, n)

    def groups(batches):
        for part, _, value, n in whole_groups(batches, ("part", "kind"), ("value", "n")):
            for a, b in zip(*runs(part), strict=True):
                yield int(part[a]), np.concatenate([np.cumsum(unpacked(x), dtype=np.uint64) for x in value[a:b]]), np.concatenate([unpacked(x).astype(np.int64) + 1 for x in n[a:b]])

    def mark(batches):
        for part, value, n in groups(batches):
            value, n = summed(value, n)
            level = np.minimum(np.log2(n).astype(np.int64), 15)
            filled = np.cumsum(np.bincount(level, minlength=16)[::-1])[::-1]
            level[level < int((filled > size // 4).sum())] = 0
            own = np.zeros(size, np.uint8)
            some = level > 0
            np.maximum.at(own, (value[some] * np.uint64(size) >> np.uint64(24)).astype(np.int64), level[some].astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([(own[::2] << 4 | own[1::2]).tobytes()], pa.binary())], names=["part", "slots"])

    dealt = texts.select("text").mapInArrow(count, "part long, value binary, n binary").withColumn("kind", F.lit(0))
    found = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(mark, "part long, slots binary").toArrow()
    whole = np.zeros(many * size // 2, np.uint8)
    for part, own in zip(found.column("part").to_pylist(), found.column("slots").to_pylist(), strict=True):
        whole[part * size // 2 : (part + 1) * size // 2] = np.frombuffer(own, np.uint8)
    return whole


def cell_of(h: np.ndarray) -> np.ndarray:
    """24 bits, by which shingles are counted within their group: few enough to be told by short gaps."""
    return (h & _LOW32) >> np.uint64(8)


def slots_of(many: int) -> int:
    """Slots of a group."""
    return max(8, MAP_SLOTS // many // 8 * 8)


def level_of(h: np.ndarray, many: int, known: np.ndarray) -> np.ndarray:
    """Where a shingle comes in the order, by the map: those of few texts first."""
    size = np.uint64(slots_of(many))
    at = group_of(h, many) * size + (cell_of(h) * size >> np.uint64(24))
    both = known[(at >> np.uint64(1)).astype(np.int64)]
    return np.where(at & np.uint64(1) == 0, both >> 4, both & 15)


def prefix_keys(sets: list[np.ndarray], least: float, many: int, known: np.ndarray, shared: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that come first in each set, and their sets' places: any two sets with a Jaccard similarity of
    ``least`` or more have ``shared`` in common, or all that they have in common if that is less."""
    sizes = np.array([len(x) for x in sets], np.int64)
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((h, level_of(h, many, known), owner))
    place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[owner]
    first = place < (sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + shared)[owner]
    return h[order][first], owner[first]


def starred(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the least id of each, and the links (a > b, each once) of the other ids with it."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    first, end = runs(key)
    low = np.repeat(ids[first], end - first)
    tied = ids != low
    a, b = ids[tied], low[tied]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return key[first], ids[first], a[new], b[new]


def ordering(texts: DataFrame, width: int, n_bytes: int) -> tuple[int, int, Broadcast]:
    """Partitions and groups of hashes for texts of ``n_bytes`` in all, and the map of common shingles."""
    spark = texts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // (256 << 20))
    many = min(max(4 * parts, n_bytes // GROUP_BYTES + 1), 1 << 22)
    return parts, many, spark.sparkContext.broadcast(frequency_map(texts, width, many, parts))


def candidates(texts: DataFrame, width: int, least: float, order: tuple[int, int, Broadcast]) -> DataFrame:
    """a > b: links between texts (key, text), such that every pair of a Jaccard similarity of ``least`` or more is in a
    component; and those that the deletion variants of the SimHash tie.

    Of the texts with a key each batch sends one and links the others to it, so a key that very many share comes once
    a batch."""
    parts, many, known = order
    sent = pa.schema([("part", pa.int64()), ("kind", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])
    pair = pa.schema([("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def deal(batches):
        for batch in pieces(batches, 4 << 20):
            ids, place = np.unique(batch.column("key").to_numpy(), return_index=True)
            own = texts_of(batch)
            hashes = [shingle_hashes(own[i], width) for i in place.tolist()]
            fps = np.array([fingerprint(x) for x in hashes], np.uint64)
            keys, owner = prefix_keys([np.unique(x) for x in hashes], least, many, known.value)
            keys, firsts, a, b = starred(group_of(keys, many) << np.uint64(32) | keys & _LOW32, ids[owner])
            rows = [(int(ids[0]) % many, 1, a.tobytes(), b.tobytes()), (int(ids[0]) % many, 2, ids.tobytes(), fps.tobytes())]
            part = keys >> np.uint64(32)
            for i, j in zip(*(x.tolist() for x in runs(part)), strict=True):
                rows.append((int(part[i]), 0, packed(np.diff(keys[i:j] & _LOW32, prepend=np.uint64(0))), firsts[i:j].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent)

    def meet(batches):
        for part, kind, x, y in whole_groups(batches, ("part", "kind"), ("x", "y")):
            group = np.cumsum(np.append(True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])))
            for i, j in zip(*runs(group), strict=True):
                a, b = b"".join(x[i:j]), np.frombuffer(b"".join(y[i:j]), np.int64)
                if kind[i]:
                    a = np.frombuffer(a, np.int64)
                else:
                    a, b = starred(np.concatenate([np.cumsum(unpacked(v), dtype=np.uint64) for v in x[i:j]]), b)[2:]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind[i] == 2, np.int64)), pa.array(a), pa.array(b)], schema=pair)

    dealt = texts.select("key", "text").mapInArrow(deal, "part long, kind long, x binary, y binary")
    met = materialized(dealt.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(meet, "kind long, a long, b long"))
    marks = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    nodes = materialized(marks.groupBy("fp").agg(F.min("key").alias("id"), F.count("*").alias("n")))
    equal = marks.join(nodes.where("n > 1"), "fp").where("key > id").select(F.col("key").alias("a"), F.col("id").alias("b"))
    return met.where("kind = 0").select("a", "b").unionByName(links(nodes.select("id", "fp"))).unionByName(equal)


def sketch(hashes: np.ndarray) -> bytes:
    """A bit for each of the hashes' last bits: whether an odd number of them has these.  About a bit a hash."""
    size = 1 << max(6, (len(hashes) * 3 // 4).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many shingles the sets of two sketches differ at least.  The longer one is folded."""
    a, b, size = (x, y, len(x)) if len(x) >= len(y) else (y, x, len(y))
    whole = int.from_bytes(a, "little")
    while size > len(b):
        size //= 2
        whole = whole >> 8 * size ^ whole & (1 << 8 * size) - 1
    return (whole ^ int.from_bytes(b, "little")).bit_count()


def paired(key: np.ndarray, ids: np.ndarray, small: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """a > b, each once, and n: every two ids with a key and how many they share (SHARED each where one of them is ``small``);
    and where more than PAIRED have a key, the links of all with the least."""
    order = np.lexsort((ids, key))
    key, ids, small = key[order], ids[order], small[order]
    first, end = runs(key)
    crowded = np.repeat(end - first > PAIRED, end - first)
    a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, PAIRED):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & ~crowded[lag:] & (ids[lag:] != ids[:-lag]))
        a.append(ids[i + lag])
        b.append(ids[i])
        n.append(np.where(small[i + lag] | small[i], SHARED, 1))
    a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return (a[at], b[at], np.add.reduceat(n, at) if len(at) else n), starred(key[crowded], ids[crowded])[2:]


def narrowed(texts: DataFrame, crowd: DataFrame, width: int, least: float, order: tuple[int, int, Broadcast]) -> DataFrame:
    """a > b: links between those of the texts (key, text) whose keys are in ``crowd``, such that every pair of them with a
    Jaccard similarity of ``least`` or more is in a component.  A few of the other texts may come along.

    Such two share SHARED keys (or a crowded one, or all that a small set has), so a single key in common, which chance gives,
    makes no pair whose sketches would meet.
    Of the texts with a key a batch sends PAIRED + 1 at most, so that the key counts as crowded where it arrives."""
    parts, many, known = order
    place = F.pmod("key", F.lit(FILTER_BITS))
    bits = crowd.select(F.shiftright(place, 15).alias("page"), place.bitwiseAND(32767).alias("bit"))
    marks = np.zeros(FILTER_BITS // 8, np.uint8)
    for page, own in zip(*(x.to_pylist() for x in bits.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("own")).toArrow().columns), strict=True):
        marks[page << 12 : page + 1 << 12] = np.frombuffer(own, np.uint8)
    inside = texts.sparkSession.sparkContext.broadcast(marks)
    sent = pa.schema([("part", pa.int64()), ("kind", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
    found = pa.schema([("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def deal(batches):
        for batch in pieces(batches, 4 << 20):
            ids, place = np.unique(batch.column("key").to_numpy(), return_index=True)
            at = ids % FILTER_BITS
            mine = inside.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            ids = ids[mine]
            if not len(ids):
                continue
            sets = [np.unique(shingle_hashes(x, width)) for x in texts_of(batch.select(["text"]).take(pa.array(place[mine])))]
            keys, owner = prefix_keys(sets, least, many, known.value, SHARED)
            # Sets that may have fewer shingles in common than SHARED.
            small = (np.ceil(least * np.array([len(x) for x in sets]) - 1e-9) < SHARED)[owner]
            keys, owner = group_of(keys, many) << np.uint64(32) | keys & _LOW32, ids[owner]
            order = np.lexsort((owner, keys))
            keys, owner, small = keys[order], owner[order], small[order]
            first, end = runs(keys)
            crowded = np.repeat(end - first > PAIRED, end - first)
            a, b = starred(keys[crowded], owner[crowded])[2:]
            few = np.arange(len(keys)) - np.repeat(first, end - first) <= PAIRED
            keys, owner, small = keys[few], owner[few], small[few]
            rows = [(int(ids[0]) % many, 1, a.tobytes(), b.tobytes(), b"")]
            rows += [(i % many, 2, np.array([i, len(x)], np.int64).tobytes(), sketch(x), b"") for i, x in zip(ids.tolist(), sets, strict=True)]
            part = keys >> np.uint64(32)
            for i, j in zip(*(x.tolist() for x in runs(part)), strict=True):
                rows.append((int(part[i]), 0, packed(np.diff(keys[i:j] & _LOW32, prepend=np.uint64(0))), owner[i:j].tobytes(), small[i:j].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent)

    def rows_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, own: list | None = None) -> pa.RecordBatch:
        n = np.zeros(len(a), np.int64) if n is None else n
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int64)), pa.array(a), pa.array(b), pa.array(n, pa.int64()), pa.array(own or [None] * len(a), pa.binary())], schema=found)

    def meet(batches):
        for part, kind, x, y, z in whole_groups(batches, ("part", "kind"), ("x", "y", "z")):
            group = np.cumsum(np.append(True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])))
            for i, j in zip(*runs(group), strict=True):
                if kind[i] == 2:
                    own = np.frombuffer(b"".join(x[i:j]), np.int64).reshape(-1, 2)
                    yield rows_of(2, own[:, 0].copy(), own[:, 1].copy(), own=list(y[i:j]))
                elif kind[i] == 1:
                    yield rows_of(1, np.frombuffer(b"".join(x[i:j]), np.int64), np.frombuffer(b"".join(y[i:j]), np.int64))
                else:
                    every, tied = paired(np.concatenate([np.cumsum(unpacked(v), dtype=np.uint64) for v in x[i:j]]), np.frombuffer(b"".join(y[i:j]), np.int64), np.frombuffer(b"".join(z[i:j]), np.bool_))
                    yield rows_of(0, *every)
                    yield rows_of(1, *tied)

    def near(batches):
        for batch in batches:
            m, n, x, y = (batch.column(c).to_pylist() for c in ("m", "n", "x", "y"))
            most = [(i + j) * (1 - least) / (1 + least) + 1e-6 for i, j in zip(m, n, strict=True)]
            kept = pa.array([apart(i, j) <= d for i, j, d in zip(x, y, most, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(kept)

    dealt = texts.select("key", "text").mapInArrow(deal, "part long, kind long, x binary, y binary, z binary")
    met = materialized(dealt.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(meet, "kind long, a long, b long, n long, sketch binary"))
    every = met.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED).select("a", "b")
    one = met.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("size"), "sketch")
    first = one.select(F.col("key").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x"))
    other = one.select(F.col("key").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y"))
    sized = every.join(first, "a").join(other, "b").where(F.least("m", "n") >= F.greatest("m", "n") * F.lit(least) - 1e-6)
    return sized.mapInArrow(near, "a long, b long").unionByName(met.where("kind = 1").select("a", "b"))


def _similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the place of the first in its component, links being Jaccard similarities of ``least`` or more.

    Breadth-first search with an inverted index of the sets not yet reached, built anew when half of them are."""
    sizes = np.array([len(x) for x in sets], np.int64)
    root = np.full(len(sets), -1)

    def index(rest: np.ndarray):
        every = np.concatenate([sets[i] for i in rest])
        order = np.argsort(every, kind="stable")
        return every[order], np.repeat(np.arange(len(rest)), sizes[rest])[order], rest

    every, owner, rest = index(np.arange(len(sets)))
    missing = len(sets)
    for seed in range(len(sets)):
        if root[seed] >= 0:
            continue
        root[seed], front = seed, [seed]
        missing -= 1
        while front and missing:
            if missing < len(rest) // 2:
                every, owner, rest = index(np.flatnonzero(root < 0))
            own = sets[front.pop()]
            low = np.searchsorted(every, own)
            shared = np.bincount(owner[ragged(low, np.searchsorted(every, own, side="right") - low)], minlength=len(rest))
            near = rest[(root[rest] < 0) & (shared > 0) & (shared >= least * (sizes[rest] + len(own) - shared))]
            root[near] = seed
            missing -= len(near)
            front.extend(near.tolist())
    return root


def verified_links(texts: DataFrame, groups: DataFrame, width: int, least: float, block: int = BLOCK_BYTES) -> DataFrame:
    """a > b: of the texts (uid, text) in each candidate component (uid, node, root, n_bytes) links that have the components
    of all pairs whose shingle sets are similar enough.  A component of more than ``block`` bytes is dealt out over pairs
    of blocks."""
    whole = materialized(groups.groupBy("root").agg(F.sum("n_bytes").alias("n")))
    sized = materialized(groups.join(whole, "root").select("uid", "node", "root", F.ceil((F.col("n") + 1) / block).cast("int").alias("blocks")))
    # Most texts are in no component, and they needn't be shuffled.
    near = texts.join(slots(sized, "uid"), slot(texts["uid"]) == F.col("slot"), "left_semi")
    members = near.join(sized, "uid").select("root", "blocks", "node", "text")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own) * F.col("blocks") + F.greatest(j, own))
    # Texts are dealt and not their shingles' hashes, which are longer and can't be compressed.
    dealt = members.select("root", F.explode(pairs).alias("part"), "node", "text")
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(parts, "root", "part").sortWithinPartitions("root", "part", "node")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        for root, part, node, text in whole_groups(pieces(batches, 4 << 20), ("root", "part"), ("node", "text")):
            group = np.cumsum(np.append(True, (root[1:] != root[:-1]) | (part[1:] != part[:-1])))
            for a, b in zip(*runs(group), strict=True):
                ids, at = np.unique(node[a:b], return_index=True)  # equal rows come twice
                if len(ids) < 2:
                    continue
                first = _similar([np.unique(shingle_hashes(text[a + i] or "", width)) for i in at.tolist()], least)
                tied = np.flatnonzero(first != np.arange(len(ids)))
                x, y = ids[tied], ids[first[tied]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], schema=pair)

    return dealt.mapInArrow(check, "a long, b long").distinct()


def with_digests(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, text, digest (of the text) and uid (of the whole row)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    plain = [F.to_json(F.struct(c.alias("c"))) if "map<" in t or "variant" in t else c for c, (n, t) in zip(others, (x for x in docs.dtypes if x[0] not in ("doc_id", "text")), strict=True)]
    rest: Column = F.concat(*[F.hex(F.xxhash64(F.lit(i), *plain)) for i in (1, 2)])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), rest.alias("rest"))
    uid = F.unhex(F.md5(F.concat_ws(" ", F.hex("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "rest")))
    return rows.withColumn("uid", uid)


def one_each(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """``rows`` (uid, text) with those of equal uids (``twice`` has these) once: a task passes on one, and these meet by uid.

    The rows of other uids stay where they are."""
    inside = slot(rows["uid"]) == F.col("slot")
    alone = rows.join(slots(twice, "uid"), inside, "left_anti")
    schema = rows.schema

    def first(batches):
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for uid in batch.column("uid").to_pylist():
                new.append(uid not in seen)
                seen.add(uid)
            yield batch.filter(pa.array(new, pa.bool_()))

    again = rows.join(slots(twice, "uid"), inside, "left_semi").mapInArrow(first, schema)
    return alone.unionByName(again.dropDuplicates(["uid"]))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """The documents without all but one (the smallest doc_id) of each group of near-duplicates."""
    rows = with_digests(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    marked = materialized(rows.select("uid", "digest", first.alias("first"), F.octet_length("text").cast("long").alias("n_bytes")))
    texts = marked.groupBy("digest").agg(F.min("first").alias("first"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    # The numbers stand in the checkpoint, so they are given once.
    texts = materialized(texts.withColumn("node", F.monotonically_increasing_id()))
    again = texts.where("copies > 1").select("digest", F.col("first.uid").alias("kept"))
    copies = materialized(marked.join(again, "digest").where("uid <> kept").select("uid").distinct())
    ids = marked.select("uid")
    key = F.xxhash64("digest")
    # Rows equal in every column count once from here on.
    equal = materialized(ids.groupBy("uid").count().where("count > 1").select("uid"))
    unique = rows.select("uid", "text", key.alias("key"))
    if not equal.isEmpty():
        unique = one_each(unique, equal)
    single = without(unique.select("uid", "key", "text"), ids, copies)
    n_bytes = texts.agg(F.sum("n_bytes")).first()[0] or 0
    order = ordering(single, width, n_bytes)
    known = texts.select(key.alias("key"), "node", F.col("first.uid").alias("uid"), "n_bytes")
    members = lambda found: materialized(components(found).withColumnRenamed("node", "key").join(known, "key"))
    groups = members(candidates(single, width, least, order))
    # At most one row for each BLOCK_BYTES of text.
    large = materialized(groups.groupBy("root").agg(F.sum("n_bytes").alias("n")).where(F.col("n") >= BLOCK_BYTES).select("root"))
    if not large.isEmpty():
        crowd = groups.join(F.broadcast(large), "root", "left_semi").select("key")
        again = members(narrowed(single, crowd, width, least, order))
        again = again.join(crowd, "key", "left_semi")
        groups = materialized(groups.join(F.broadcast(large), "root", "left_anti").unionByName(again))
    linked = components(verified_links(unique.select("uid", "text"), groups, width, least))
    # Of each component the smallest (doc_id, uid) stays; of a text's copies the first.
    met = materialized(texts.select("first", "node").join(linked, "node").select("root", "first"))
    best = materialized(met.groupBy("root").agg(F.min("first").alias("best")))
    lost = met.join(best, "root").where("first.uid <> best.uid").select(F.col("first.uid").alias("uid"))
    lost = materialized(lost.unionByName(copies))
    kept = without(rows.select("uid", "row"), ids, lost)
    twice = materialized(equal.join(lost, "uid", "left_anti").select("uid"))
    if twice.isEmpty():
        return kept.select("row.*")
    # Rows equal in every column meet; the others stay where they are.
    inside = slot(kept["uid"]) == F.col("slot")
    alone = kept.join(slots(twice, "uid"), inside, "left_anti")
    merged = kept.join(slots(twice, "uid"), inside, "left_semi").groupBy("uid").agg(F.first("row").alias("row"))
    return alone.unionByName(merged.select("uid", "row")).select("row.*")

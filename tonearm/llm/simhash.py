"""SimHash near-duplicates by deletion variants (operator 6).

A fingerprint of 64 bits is cut into few segments, so that of two fingerprints
within ``distance`` bits at least one segment differs in one bit at most.
Every segment is indexed once for each of its bits with that bit blanked; equal
variants meet in an equality join and the whole fingerprints are compared.

Only distinct fingerprints are indexed.  The variants that blank a bit of one
half of a segment agree in its other half, so a fingerprint is sent once for
each half, keyed by the other, and makes its variants where it arrives.  Halves
that very many fingerprints share make theirs before they are sent; a variant
shared by more than ``block`` is dealt out over the pairs of its blocks, so no
task holds it whole and no pair is lost; within a group of blocks links are
found by breadth-first search, which gives a spanning forest and not all pairs.
Components come from alternating large-star and small-star steps.

Defined results: a null or empty text has fingerprint zero, linked like any
other; rows with a null id share in the links, and a component of null ids
alone has a null id; repeated rows have equal results; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, materialized, pieces, slot, texts_of

BITS = 64
BLOCK = 4096
#: One node in so many tells which variants are hot.
SAMPLE = 64
#: A half is crowded with so many sampled nodes and four times the mean.
CROWD = 16


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the space-joined shingles of a text's lower-cased words, repeats included."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.append(0, ends[:-1] + 1)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and fp (the 64 bits as a long), which replaces a column of that name."""
    from pyspark.sql.types import LongType, StructField, StructType

    kept = [c for c in docs.columns if c not in (text, "fp")]
    out = StructType([*[docs.schema[c] for c in kept], StructField("fp", LongType())])

    def run(batches):
        for batch in pieces(batches):
            fps = np.array([fingerprint(shingle_hashes(x, width)) for x in texts_of(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(fps)], names=[*kept, "fp"])

    return docs.select(*kept, text).mapInArrow(run, out)


def segment_masks(distance: int) -> list[int]:
    """Bit masks of distance // 2 + 1 segments: of fingerprints within ``distance`` one segment at least differs in one bit at most."""
    count = distance // 2 + 1
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def halves(masks: list[int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each half of each mask the rest of that mask, and the (number, mask) of the variants that blank one of the half's bits."""
    out, number = [], 0
    for mask in masks:
        bits = [b for b in range(BITS) if mask >> b & 1]
        for own in (bits[: len(bits) // 2], bits[len(bits) // 2 :]):
            out.append((mask & ~sum(1 << b for b in own), [(number + i, mask & ~(1 << b)) for i, b in enumerate(own)]))
            number += len(own)
    return out


def keyed(fp: Column, mask: int, tag: int) -> Column:
    """A hash of the masked fingerprint, and a number below 512 in its last bits."""
    return F.shiftleft(F.xxhash64(fp.bitwiseAND(signed(mask))), 9).bitwiseOR(F.lit(tag))


def _canonical(x: np.ndarray, tag: np.ndarray, masks: list[int]) -> np.ndarray:
    """Of the variants in which two fingerprints meet, is this the first?  x: their difference."""
    first = np.full(len(x), -1)
    base = np.cumsum([0] + [m.bit_count() for m in masks])
    for mask, start in reversed(list(zip(masks, base.tolist(), strict=False))):
        own = x & np.uint64(mask)
        place = start + np.where(own == 0, 0, np.bitwise_count(np.uint64(mask) & (np.maximum(own, np.uint64(1)) - np.uint64(1))))
        first = np.where(np.bitwise_count(own) <= 1, place, first)
    return first == tag


def _forest(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each of a group's nodes the place of its component's first, by breadth-first search."""
    n = len(fp)
    root = np.full(n, -1)
    rest = np.arange(n)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        rest = rest[rest != seed]
        front = np.array([seed])
        while len(front) and len(rest):
            part, front = front[:64], front[64:]
            hit = (np.bitwise_count(fp[part][:, None] ^ fp[rest][None, :]) <= distance).any(0)
            root[rest[hit]] = seed
            front = np.append(front, rest[hit])
            rest = rest[~hit]
    return root


def whole_groups(batches, keys: tuple[str, str], others: tuple[str, ...]):
    """Columns of sorted batches, cut so that no group (equal keys) is in two."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, *others)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        last = int(new[-1]) if len(new) else 0  # the last group may go on in the next batch
        if last:
            yield [x[:last] for x in now]
        held = [x[last:] for x in now]
    if held is not None:
        yield held


def links(nodes: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """a > b: links between nodes (id, fp) with the components of all links within ``distance`` bits."""
    count = nodes.count()
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 1_000_000)
    masks = segment_masks(distance)
    sides = halves(masks)
    half = F.explode(F.array(*[keyed(F.col("fp"), rest, g) for g, (rest, _) in enumerate(sides)])).alias("half")
    # Which halves and variants very many nodes share, from one node in SAMPLE: it decides how they are sent, not what is found.
    few = nodes.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(SAMPLE)) == 0)
    mean = count / SAMPLE / 2 ** min(rest.bit_count() for rest, _ in sides)
    crowded = few.select(half).groupBy("half").count().where(F.col("count") > max(CROWD, 4 * mean))
    crowded = materialized(crowded.select(slot(F.col("half")).alias("slot")).distinct().coalesce(1))  # at most SLOTS rows
    sent = nodes.repartition(parts, "id").select("id", "fp", half)
    calm, met = sent, None
    if not crowded.isEmpty():
        inside = slot(sent["half"]) == F.col("slot")
        calm = sent.join(F.broadcast(crowded), inside, "left_anti")
        each = F.array(*[F.array(*[keyed(F.col("fp"), m, t) for t, m in own]) for _, own in sides])
        key = F.explode(F.element_at(each, F.col("half").bitwiseAND(511).cast("int") + 1)).alias("key")
        index = sent.join(F.broadcast(crowded), inside, "left_semi").select("id", "fp", key)
        hot = few.select("id", "fp", half).join(F.broadcast(crowded), slot(F.col("half")) == F.col("slot"), "left_semi").select(key).groupBy("key").agg(F.count("*").alias("n"))
        hot = hot.where(F.col("n") > block // SAMPLE).groupBy(slot(F.col("key")).alias("slot")).agg(F.max("n").alias("n"))
        hot = materialized(hot.select("slot", F.ceil(F.col("n") * SAMPLE / block).cast("int").alias("blocks")).where("blocks > 1").coalesce(1))
        # Every pair of blocks of a hot variant is a group of its own.  At most SLOTS rows are broadcast.
        of = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64("id"), of).cast("int")
        groups = F.transform(F.sequence(F.lit(0), of - 1), lambda j: F.least(j, own) * of + F.greatest(j, own))
        met = index.join(F.broadcast(hot), slot(F.col("key")) == F.col("slot"), "left").select("id", "fp", "key", F.explode(groups).alias("part"))
        met = met.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "id")
    calm = calm.withColumn("part", F.lit(0)).repartition(parts, "half").sortWithinPartitions("half", "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def group_links(key: np.ndarray, ids: np.ndarray, fp: np.ndarray, run: np.ndarray):
        """run: the group of each row, in order."""
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        sizes = np.diff(np.append(starts, len(run)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.repeat(sizes < 64, sizes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        found = [np.zeros((2, 0), np.int64)]
        for lag in range(1, int(sizes[sizes < 64].max(initial=0))):
            i = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:])
            near = np.bitwise_count(fp[i] ^ fp[i + lag]) <= distance
            found.append(np.stack([i[near], i[near] + lag]))
        i, j = np.concatenate(found, axis=1)
        # A group with more links than nodes gives a spanning forest instead.
        dense = (np.bincount(of[i], minlength=len(sizes)) > sizes) | (sizes >= 64)
        i, j = i[~dense[of[i]]], j[~dense[of[i]]]
        first = _canonical(fp[i] ^ fp[j], key[i] & 511, masks)
        a.append(ids[i[first]])
        b.append(ids[j[first]])
        for s, m in zip(starts[dense], sizes[dense], strict=True):
            own = ids[s : s + m]
            root = _forest(fp[s : s + m], distance)
            tied = root != np.arange(m)
            a.append(own[tied])
            b.append(own[root[tied]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=schema)

    def run(batches):
        for key, part, ids, fp in whole_groups(batches, ("key", "part"), ("id", "fp")):
            new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            yield group_links(key, ids, fp.view(np.uint64), np.cumsum(new))

    def run_halves(batches):
        for half, _, ids, fp in whole_groups(batches, ("half", "part"), ("id", "fp")):
            fp = fp.view(np.uint64)
            for g in np.unique(half & 511).tolist():
                mine = np.flatnonzero(half & 511 == g)
                for t, mask in sides[g][1]:
                    cut = fp[mine] & np.uint64(mask)
                    order = np.lexsort((ids[mine], cut))
                    own, cut = mine[order], cut[order]
                    again = cut[1:] == cut[:-1]
                    shared = np.append(again, False) | np.append(False, again)  # most variants have one node
                    own, cut = own[shared], cut[shared]
                    if len(own):
                        yield group_links(np.full(len(own), t), ids[own], fp[own], np.append(0, np.cumsum(cut[1:] != cut[:-1])))

    found = calm.mapInArrow(run_halves, "a long, b long")
    return (found if met is None else found.unionByName(met.mapInArrow(run, "a long, b long"))).distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of every node that has a link (a > b); root is the smallest node reachable."""

    now = materialized(edges.select("a", "b").where("a > b").distinct())
    # Few edges need few files.
    parts = now.count() // 200_000 + 1
    kept = lambda df: materialized(df.coalesce(parts))
    now = kept(now)

    def lowest(pairs: DataFrame) -> DataFrame:
        # Written out, so that the join below can split a hub's rows.
        return kept(pairs.groupBy("a").agg(F.min("b").alias("m")))

    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = lowest(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = kept(large)
        m = lowest(large)
        small = large.join(m, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        now = kept(small.select("x.*").where("a > b").distinct())
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if new == mark and new[0] == new[2]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = new
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    marked = materialized(fingerprints(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), width))
    nodes = materialized(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(nodes.select(F.col("fp").alias("id"), "fp"), distance))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialized(joined)
    smallest = materialized(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = materialized(joined.join(smallest, "root").select("fp", "component_id"))
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Phrase collocations by a minimal perfect hash over Apriori-safe candidates (operator 13).

A word has a 128-bit key (of itself and its language) and a phrase the
polynomial of its words' keys.  Texts are cut into words once: blocks of them
are written as codes with their keys.  Words first, then phrases of two to five
words: a phrase is looked at only where its first and its last n - 1 words can
have ``least`` occurrences, as no phrase has more than its parts.  Mappers sum
the phrases of a level by 48-bit cells, packed by ranges of cells; a phrase
whose cell stays below ``least`` is no candidate (phrases that share a cell only
add to it).  A bit filter of bounded size tells which cells reach it; where it
is full more phrases are looked at and none is lost.

The candidates, with the block that has each first, get slots from a minimal
perfect hash.  Mappers look up every phrase, verify the key that its slot stores,
and add a bincount to a numpy array of slots; the arrays are summed as a tree, in
blocks.  Each candidate then reads its count, those of its cuts, and those of the
phrases inside it, by slot.  The hash with its keys is broadcast up to
``MOST_SLOTS`` candidates (26 bytes each); beyond that they are dealt into shards
of that many, each with a hash of its own: mappers send the phrases that the
filters pass, summed by block, to the shards, and the cuts are read by joins.
Both ways count all candidates.

Defined results: a null or empty text has no words; a null language is ``und``
(and is one with it); each row counts, repeated or not, and its id is not read; a
text, a piece or a word of any length counts whole; ties go by the phrase's
UTF-8 bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialized, pieces

LEAST, LONGEST, TOP = 100, 5, 2000
#: Candidates that one hash may have, and so what is broadcast: 52 MB.
MOST_SLOTS = 1 << 21
#: Slots of a block of the count arrays, arrays that one task sums at a step of the tree.
BLOCK, FAN_IN = 1 << 16, 32
#: Bits of a cell, and words of the corpus for each range of cells.
CELL_BITS, CELLS_OF_RANGE = 48, 1 << 21
#: Bits of a filter for each key, and the most bits of a filter (32 MB).
BITS_PER_KEY, MOST_BITS = 64, 1 << 28
#: Odd multipliers of the two halves of a phrase's key.
_BY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Separators of pieces become line ends, A-Z become a-z, tabs become spaces.
_FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = b"\xff"  # in no UTF-8 text


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 128-bit keys, with the keys to verify.

    Keys that are alone at their place of a bit vector have their slot by its rank; the others go on to the next one."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        left, n = np.arange(len(high)), 0
        slot = np.empty(len(high), np.int64)
        while len(left):
            size = max(64, -(-len(left) * 3 // 2 // 64) * 64)
            at = self.place(high[left], low[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            rank = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1))])[:-1]
            words = np.packbits(bits, bitorder="little").view("<u8")
            self.levels.append((size, words, rank, n))
            slot[left[alone]] = self.rank(self.levels[-1], at[alone])
            n += int(alone.sum())
            left = left[~alone]
            if len(self.levels) > 200:
                raise ValueError("keys must be distinct")
        self.high, self.low = np.empty(len(high), np.uint64), np.empty(len(high), np.uint64)
        self.high[slot], self.low[slot] = high, low

    def __len__(self) -> int:
        return len(self.high)

    @staticmethod
    def place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(high ^ mixed(low + np.uint64(level * 2 + 1))) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def rank(level: tuple[int, np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        _, words, rank, first = level
        below = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return first + rank[at >> 6] + np.bitwise_count(below)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that isn't there."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for i, level in enumerate(self.levels):
            at = self.place(high[left], low[left], i, level[0])
            hit = (level[1][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            slot, who = self.rank(level, at[hit]), left[hit]
            same = (self.high[slot] == high[who]) & (self.low[slot] == low[who])
            out[who[same]] = slot[same]
            left = left[~hit]
            if not len(left):
                break
        return out


def keys_of(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, seed=seed) for w in words]), ">u8").reshape(-1, 2).astype(np.uint64)
    return raw[:, 0].copy(), raw[:, 1].copy()


def inner_keys(lang: str, words: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """i, j and the key of the phrase of words i to j - 1, for each run of words of a phrase."""
    one = [x.tolist() for x in keys_of(lang, [w.encode() for w in words])]
    by, mask = [int(x) for x in _BY], (1 << 64) - 1
    for i in range(len(words)):
        high = low = 0
        for j in range(i, len(words)):
            high, low = (high * by[0] + one[0][j]) & mask, (low * by[1] + one[1][j]) & mask
            yield i, j + 1, high, low


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


_BLOCKS = pa.schema([("lang", pa.string()), ("codes", pa.binary()), ("high", pa.binary()), ("low", pa.binary()), ("words", pa.binary())])


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts of one language as the numbers of their words in order (0 parts pieces), the words' keys and the words."""
    for batch in pieces(batches):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, [_BREAK]).append(text or b"")
        for lang, own in texts.items():
            tokens = folded(b"\n".join(own)).replace(b"\n", b" " + _BREAK + b" ").split()
            coded = pa.array(tokens, pa.binary()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()  # the break came first
            row = ([lang], [coded.indices.to_numpy(zero_copy_only=False).astype("<i4").tobytes()], *([k.tobytes()] for k in keys_of(lang, distinct)), [b" ".join(distinct)])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)


class Words:
    """The words of a block in order, with breaks between pieces."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        own = {c: batch.column(c)[row] for c in batch.schema.names}
        self.lang, self.block = own["lang"].as_py(), own["block"].as_py()
        self.codes = np.frombuffer(own["codes"].as_buffer(), np.int32)
        self.keys = tuple(np.frombuffer(own[c].as_buffer(), np.uint64) for c in ("high", "low"))
        self.is_word = np.arange(len(self.keys[0])) > 0
        self.raw, self.distinct = own.get("words"), None

    def phrase(self, at: int, n: int) -> str:
        if self.distinct is None:
            self.distinct = self.raw.as_py().split(b" ")
        return b" ".join([self.distinct[c] for c in self.codes[at : at + n].tolist()]).decode("utf-8", "replace")

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.bincount(self.codes, minlength=len(self.is_word))
        return self.keys[0][self.is_word], self.keys[1][self.is_word], n[self.is_word]

    def phrases(self, filters: list[Filter], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """n, places and keys of the phrases of 2, 3, ... ``longest`` words whose first and last n - 1 words pass the filters."""
        words = [k[self.codes] for k in self.keys]
        ok = self.is_word.copy()
        ok[self.is_word] = filters[0].has(self.keys[0][self.is_word], self.keys[1][self.is_word])
        passes = ok[self.codes]  # of the phrases of n - 1 words
        high, low = words
        for n in range(2, longest + 1):
            at = np.flatnonzero(passes[:-1] & passes[1:])
            if not len(at):
                return
            new = [np.zeros(len(self.codes), np.uint64) for _ in range(2)]
            for side, (x, before) in enumerate(zip(new, (high, low), strict=True)):
                x[at] = before[at] * _BY[side] + words[side][at + n - 1]
            high, low = new
            yield n, at, high[at], low[at]
            passes = np.zeros(len(self.codes), bool)
            if n < longest:
                passes[at] = filters[n - 1].has(high[at], low[at])


class Filter:
    """A bit for each cell: no key whose cell was put in is missed."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, np.uint64(len(words) * 64)

    def has(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        at = cell(high, low) % self.bits
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def cell(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mixed(high ^ low) >> np.uint64(64 - CELL_BITS)


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        high, low = (batch.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
        yield pa.RecordBatch.from_arrays([pa.array(cell(high, low).view(np.int64))], names=["cell"])


def filter_of(cells: DataFrame) -> Filter:
    """The filter of a table of cells, made of words of 64 bits; its size is bounded, so the driver may hold it."""
    n = cells.count()
    bits = min(MOST_BITS, 1 << max(16, (n * BITS_PER_KEY - 1).bit_length() if n else 0))
    at = F.col("cell") % F.lit(bits)
    rows = cells.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Words(batch, i)


def summed(high: np.ndarray, low: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and their sums; keys of equal high halves are told apart by the low ones."""
    order = np.lexsort((low, high)) if len(high) else np.zeros(0, np.int64)
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    if n is None:
        return high[at], low[at], np.diff(np.append(at, len(high)))
    return high[at], low[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


_KEYS = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("lang", pa.string()), ("count", pa.int64())])


class Sums:
    """Sums by key that go out when there are many: a word or phrase has one row for each of a task's blocks."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.parts, self.size = most, {}, 0

    def add(self, lang: str, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.setdefault(lang, []).append((high, low, n))
        self.size += len(high)
        if self.size > self.most:
            for k, own in self.parts.items():
                self.parts[k] = [summed(*(np.concatenate(x) for x in zip(*own, strict=True)))]
            self.size = sum(len(own[0][0]) for own in self.parts.values())
            if self.size > self.most // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        for lang, own in self.parts.items():
            high, low, n = summed(*(np.concatenate(x) for x in zip(*own, strict=True)))
            for a in range(0, len(high), 1 << 16):
                z = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(high[z].view(np.int64)), pa.array(low[z].view(np.int64)), pa.array([lang] * len(high[z]), pa.string()), pa.array(n[z], pa.int64())], schema=_KEYS)
        self.parts, self.size = {}, 0


def word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """high, low, lang, count (partial sums) of the words."""
    held = Sums()
    for words in each_block(batches):
        yield from held.add(words.lang, *words.counts())
    yield from held.out()


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers by planes of bytes, so that the planes of zeros compress away."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def numbers(x: pa.Scalar, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def sum_cells(filters, n: int, ranges: int, most: int = 1 << 21):
    """Partial sums of the phrases of n words by cell, packed by ranges of cells."""
    schema = pa.schema([("range", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
    width = np.uint64((1 << CELL_BITS) // ranges)

    def out(parts: list) -> Iterator[pa.RecordBatch]:
        cells, counts = added(parts)
        if not len(cells):
            return
        of = (cells // width).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rows = [(int(of[a]), planes(np.diff(cells[a:b], prepend=np.uint64(0)), 8), planes(np.minimum(counts[a:b], (1 << 32) - 1), 4)) for a, b in zip(cuts, np.append(cuts[1:], len(of)), strict=True)]
        for a in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + 256], strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for words in each_block(batches):
            for m, _, high, low in words.phrases(filters.value, n):
                if m == n:
                    cells, counts = np.unique(cell(high, low), return_counts=True)
                    parts.append((cells, counts))
                    size += len(cells)
            if size > most:
                parts = [added(parts)]
                size = len(parts[0][0])
                if size > most // 2:
                    yield from out(parts)
                    parts, size = [], 0
        if parts:
            yield from out(parts)

    return run


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    cells, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    return cells[at], np.add.reduceat(counts, at)


def reached(least: int, most: int = 1 << 22):
    """The cells whose sums reach ``least``, of rows sorted by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                cells, counts = added(parts)
                yield pa.RecordBatch.from_arrays([pa.array(cells[counts >= least].astype(np.int64))], names=["cell"])

        for batch in batches:
            for of, cells, counts in zip(batch.column("range").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
                if of != now:
                    yield from done()
                    now, parts, size = of, [], 0
                parts.append((np.cumsum(numbers(cells, 8), dtype=np.uint64), numbers(counts, 4).astype(np.int64)))
                size += len(parts[-1][0])
                if size > most:
                    parts = [added(parts)]
                    size = 0  # what is added from now on
        yield from done()

    return run


def first_blocks(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the smallest block of each."""
    high, low, block = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((block, low, high))
    high, low, block = high[order], low[order], block[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return high[new], low[new], block[new]


def candidates(filters, longest: int, ranges: int, most: int = 1 << 20):
    """The keys of the phrases whose cells and parts pass, each with a block that has it, packed by ranges of keys."""
    schema = pa.schema([("range", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("block", pa.binary())])
    width = np.uint64((1 << 64) // ranges - 1) + np.uint64(1)

    def out(parts: list) -> Iterator[pa.RecordBatch]:
        high, low, block = first_blocks(parts)
        if not len(high):
            return
        of = (high // width).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(of)), strict=True):
            own = (planes(np.diff(high[a:b], prepend=np.uint64(0)), 8), planes(low[a:b], 8), planes(block[a:b], 8))
            yield pa.RecordBatch.from_arrays([pa.array([int(of[a])]), *[pa.array([x], pa.binary()) for x in own]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for words in each_block(batches):
            for m, _, high, low in words.phrases(filters.value, longest):
                keep = filters.value[m - 1].has(high, low)
                high, low, _ = summed(high[keep], low[keep])
                parts.append((high, low, np.full(len(high), words.block, np.int64)))
                size += len(high)
            if size > most:
                parts = [first_blocks(parts)]
                size = len(parts[0][0])
                if size > most // 2:
                    yield from out(parts)
                    parts, size = [], 0
        if parts:
            yield from out(parts)

    return run


def met_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """high, low, block: each candidate once, of rows sorted by range."""
    now, parts = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if parts:
            high, low, block = first_blocks(parts)
            yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(block)], names=["high", "low", "block"])

    for batch in batches:
        for of, high, low, block in zip(batch.column("range").to_pylist(), *(batch.column(c) for c in ("high", "low", "block")), strict=True):
            if of != now:
                yield from done()
                now, parts = of, []
            parts.append((np.cumsum(numbers(high, 8), dtype=np.uint64), numbers(low, 8), numbers(block, 8).view(np.int64)))
            if len(parts) > 64:
                parts = [first_blocks(parts)]
    yield from done()


def map_counts(hashed, filters, longest: int, size: int):
    """Counts by slot in blocks of ``size``, and each phrase from the block that it was first in."""
    schema = pa.schema([("part", pa.int64()), ("counts", pa.binary()), ("slot", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, owner = hashed.value
        counts = np.zeros(len(table), np.int64)
        for words in each_block(batches):
            high, low, n = words.counts()
            slot = table.slots(high, low)
            counts += np.bincount(slot[slot >= 0], n[slot >= 0], len(table)).astype(np.int64)
            out: list[tuple] = []
            for m, at, high, low in words.phrases(filters.value, longest):
                slot = table.slots(high, low)
                at, slot = at[slot >= 0], slot[slot >= 0]
                counts += np.bincount(slot, minlength=len(table))
                mine = owner[slot] == words.block
                slot, first = np.unique(slot[mine], return_index=True)
                out += [(None, None, s, words.lang, words.phrase(a, m)) for s, a in zip(slot.tolist(), at[mine][first].tolist(), strict=True)]
            for a in range(0, len(out), 1 << 14):
                yield batch_of(out[a : a + (1 << 14)])
        for b in range(0, len(table), size):
            own = counts[b : b + size]
            if own.any():
                yield batch_of([(b // size, own.tobytes(), None, None, None)])

    return run


def sum_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array for each run of equal (part, group)."""
    schema = pa.schema([("part", pa.int64()), ("group", pa.int64()), ("counts", pa.binary())])
    key, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for part, group, counts in zip(batch.column("part"), batch.column("group"), batch.column("counts"), strict=True):
            own = np.frombuffer(counts.as_buffer(), np.int64)
            if (now := (part.as_py(), group.as_py())) == key:
                total += own
                continue
            if key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.tobytes()], pa.binary())], schema=schema)
            key, total = now, own.copy()
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.tobytes()], pa.binary())], schema=schema)


def tree_sum(arrays: DataFrame, tasks: int) -> DataFrame:
    """part and counts, of the arrays (part, group: the mapper's number, counts); no task adds more than FAN_IN arrays of a part."""
    now = arrays
    while True:
        tasks = -(-tasks // FAN_IN)
        now = now.withColumn("group", F.call_function("div", F.col("group"), F.lit(FAN_IN)))
        now = now.repartition("part", "group").sortWithinPartitions("part", "group").mapInArrow(sum_arrays, "part long, group long, counts binary")
        if tasks <= 1:
            return now.select("part", "counts")


MEASURED = "lang string, phrase string, words int, a long, l long, r long, n long, score long, inside array<string>"


def measure(a: int, n: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """score, l and r of the lowest cut, the first of equals; integers of any length."""
    score, k = min((1000 * a * n // (left * right), k) for k, (left, right) in enumerate(cuts))
    return score, *cuts[k]


def read_cuts(hashed, counted, least: int):
    """Each candidate's cuts, and the phrases inside it that occur no more often than it does, by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = hashed.value[0], counted.value
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), *[(x, pa.int64()) for x in ("a", "l", "r", "n", "score")], ("inside", pa.list_(pa.string()))])
        for batch in pieces(batches):
            rows = batch.to_pylist()
            spans, high, low = [], [], []
            for r in rows:  # every run of words of each phrase
                words, own = r["phrase"].split(" "), {}
                for i, j, h, w in inner_keys(r["lang"], words):
                    own[i, j] = len(high)
                    high.append(h)
                    low.append(w)
                spans.append((words, own))
            found = counts[table.slots(np.array(high, np.uint64), np.array(low, np.uint64))].tolist()
            out = []
            for r, (words, own) in zip(rows, spans, strict=True):
                m = len(words)
                a = found[own[0, m]]
                if a < least:  # others of its cell made it a candidate
                    continue
                score, left, right = measure(a, r["n"], [(found[own[0, k]], found[own[k, m]]) for k in range(1, m)])
                inside = {" ".join(words[i:j]) for (i, j), x in own.items() if 1 < j - i < m and found[x] <= a}
                out.append((r["lang"], r["phrase"], m, a, left, right, r["n"], score, sorted(inside)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def counted_at_once(spark: SparkSession, blocks: DataFrame, keys: DataFrame, filters, n_of_lang: DataFrame, longest: int, least: int) -> DataFrame:
    """The measured phrases, by one broadcast hash of all candidates (high, low, block)."""
    rows = keys.toArrow()  # no more than MOST_SLOTS
    table = PerfectHash(*(rows[c].to_numpy().view(np.uint64) for c in ("high", "low")))
    owner = np.empty(len(table), np.int64)
    owner[table.slots(*(rows[c].to_numpy().view(np.uint64) for c in ("high", "low")))] = rows["block"].to_numpy()
    hashed = spark.sparkContext.broadcast((table, owner))
    made = materialized(blocks.mapInArrow(map_counts(hashed, filters, longest, BLOCK), "part long, counts binary, slot long, lang string, phrase string").withColumn("group", F.spark_partition_id().cast("long")))
    total = np.zeros(len(table), np.int64)
    for r in tree_sum(made.where("part IS NOT NULL").select("part", "group", "counts"), made.rdd.getNumPartitions()).toLocalIterator():
        total[r["part"] * BLOCK :][: len(r["counts"]) // 8] = np.frombuffer(r["counts"], np.int64)
    counted = spark.sparkContext.broadcast(total)
    phrases = made.where("part IS NULL").join(n_of_lang, "lang")
    return phrases.select("lang", "phrase", "n").mapInArrow(read_cuts(hashed, counted, least), MEASURED)


def map_dealt(filters, longest: int):
    """The phrases that the filters pass, summed by block of text: keys, phrase and count."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in each_block(batches):
            for m, at, high, low in words.phrases(filters.value, longest):
                keep = filters.value[m - 1].has(high, low)
                at, high, low = at[keep], high[keep], low[keep]
                order = np.lexsort((low, high))
                at, high, low = at[order], high[order], low[order]
                new = np.ones(len(at), bool)
                new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                if len(first):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(high[first].view(np.int64)), pa.array(low[first].view(np.int64)), pa.array([words.lang] * len(first)), pa.array([words.phrase(a, m) for a in at[first].tolist()]), pa.array(n)], schema=schema
                    )

    return run


def count_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's candidates (rows without a count, which come first), then the mappers' sums; a hash of the first counts the others."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("count", pa.int64())])
    shard, keys, table, counts, told = None, [], None, None, {}

    def done() -> Iterator[pa.RecordBatch]:
        if table is not None and told:
            at = np.array(sorted(told), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table.high[at].view(np.int64)), pa.array(table.low[at].view(np.int64)), pa.array([told[i][0] for i in at.tolist()]), pa.array([told[i][1] for i in at.tolist()]), pa.array(counts[at])], schema=schema
            )

    for whole in batches:
        numbers = whole.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            batch = whole.slice(a, b - a)
            if numbers[a] != shard:
                yield from done()
                shard, keys, table, counts, told = numbers[a], [], None, None, {}
            high, low = (batch.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            is_key = batch.column("count").is_null().to_numpy(zero_copy_only=False)
            if is_key.any():
                keys.append((high[is_key], low[is_key]))
            if is_key.all():
                continue
            if table is None:
                table = PerfectHash(*(np.concatenate(x) for x in zip(*keys, strict=True))) if keys else PerfectHash(high[:0], low[:0])
                counts = np.zeros(len(table), np.int64)
            rest = np.flatnonzero(~is_key)
            slot = table.slots(high[rest], low[rest])
            rest, slot = rest[slot >= 0], slot[slot >= 0]
            n = batch.column("count").take(pa.array(rest)).to_numpy()
            np.add.at(counts, slot, n)
            for i, s in zip(rest.tolist(), slot.tolist(), strict=True):
                if s not in told:
                    told[s] = (batch.column("lang")[i].as_py(), batch.column("phrase")[i].as_py())
    yield from done()


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of words inside each phrase."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.string()), ("high", pa.int64()), ("low", pa.int64())])
    for batch in pieces(batches, 1 << 18):
        out = []
        for r in batch.to_pylist():
            words = r["phrase"].split(" ")
            out += [(r["lang"], r["phrase"], r["count"], i, j, " ".join(words[i:j]), h, w) for i, j, h, w in inner_keys(r["lang"], words) if j - i < len(words)]
        if out:
            *plain, high, low = zip(*out, strict=True)
            keys = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, f.type) for x, f in zip(plain, schema, strict=False)], *keys], schema=schema)


def counted_by_shard(blocks: DataFrame, keys: DataFrame, words: DataFrame, filters, n_of_lang: DataFrame, longest: int, least: int, most_slots: int) -> DataFrame:
    """The same, with the candidates dealt into shards and the cuts read by joins."""
    shards = max(1, -(-keys.count() * 5 // 4 // most_slots))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "high"), F.lit(shards))
    of_keys = keys.select("high", "low", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("phrase"), F.lit(None).cast("long").alias("count"))
    partial = blocks.mapInArrow(map_dealt(filters, longest), "high long, low long, lang string, phrase string, count long")
    dealt = of_keys.unionByName(partial).withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", F.col("count").asc_nulls_first())
    counted = dealt.mapInArrow(count_shard, "high long, low long, lang string, phrase string, count long")
    counted = materialized(counted.where(F.col("count") >= least))
    known = counted.select("high", "low", "count").unionByName(words.select("high", "low", "count"))
    parts = counted.select("lang", "phrase", "count").mapInArrow(spans, "lang string, phrase string, a long, i int, j int, part string, high long, low long").join(known, ["high", "low"])
    m = F.array_size(F.split("phrase", " "))
    big = lambda x: x.cast("decimal(38,0)")  # noqa: E731  1000 a n has at most 38 digits, l r as well
    own = parts.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("i", "j", "count", "part")).alias("parts")).join(n_of_lang, "lang")
    count_of = lambda i, j: F.get(F.filter("parts", lambda p: (p["i"] == i) & (p["j"] == j)), F.lit(0))["count"]
    cut = lambda k: F.struct(F.call_function("div", big(F.lit(1000)) * big(F.col("a")) * F.col("n").cast("decimal(15,0)"), big(count_of(F.lit(0), k)) * big(count_of(k, m))).alias("score"), k.alias("k"), count_of(F.lit(0), k).alias("l"), count_of(k, m).alias("r"))
    best = F.array_min(F.transform(F.sequence(F.lit(1), m - 1), cut))
    inside = F.transform(F.filter("parts", lambda p: (p["j"] - p["i"] > 1) & (p["count"] <= F.col("a"))), lambda p: p["part"])
    return own.withColumn("best", best).select("lang", "phrase", m.cast("int").alias("words"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"), inside.alias("inside"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, most_slots: int = MOST_SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of two words and more that stick together most."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    own = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("binary").alias("text"))
    # Blocks get their numbers once and keep them.
    blocks = materialized(own.mapInArrow(encode, "lang string, codes binary, high binary, low binary, words binary").withColumn("block", F.monotonically_increasing_id()))
    plain = blocks.select("block", "lang", "codes", "high", "low")
    words = materialized(plain.mapInArrow(word_sums, "high long, low long, lang string, count long").groupBy("high", "low", "lang").agg(F.sum("count").alias("count")))
    n_of_lang = materialized(words.groupBy("lang").agg(F.sum("count").alias("n")))
    frequent = materialized(words.where(F.col("count") >= least).select("high", "low", "count"))
    # A word's cell, as a column: the filters know keys by their cells alone.
    filters = [filter_of(frequent.mapInArrow(cells_of, "cell long"))]
    n = n_of_lang.agg(F.sum("n")).first()[0] or 0
    ranges = max(16, 1 << (n // CELLS_OF_RANGE).bit_length())
    for m in range(2, longest + 1):
        partial = plain.mapInArrow(sum_cells(share(filters), m, ranges), "range long, cells binary, counts binary")
        level = materialized(partial.repartition("range").sortWithinPartitions("range").mapInArrow(reached(least), "cell long"))
        filters = [*filters, filter_of(level)]
    held = share(filters)
    partial = plain.mapInArrow(candidates(held, longest, ranges), "range long, high binary, low binary, block binary")
    phrases = materialized(partial.repartition("range").sortWithinPartitions("range").mapInArrow(met_candidates, "high long, low long, block long"))
    if frequent.count() + phrases.count() <= most_slots:
        keys = frequent.select("high", "low", F.lit(-1).cast("long").alias("block")).unionByName(phrases)
        measured = counted_at_once(spark, blocks, keys, held, n_of_lang, longest, least)
    else:
        measured = counted_by_shard(blocks, phrases, frequent, held, n_of_lang, longest, least, most_slots)
    measured = materialized(measured)
    inner = measured.select("lang", F.explode("inside").alias("phrase")).distinct()
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = measured.join(inner, ["lang", "phrase"], "left_anti").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_PHRASES = ", ".join(f"CASE WHEN lead(p, {k - 1}) OVER w = p THEN {' || chr(32) || '.join(f'lead(word, {i}) OVER w' if i else 'word' for i in range(k))} END" for k in range(2, LONGEST + 1))
#: DuckDB, over every phrase of the texts.
COLLOCATIONS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT d, lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece, generate_subscripts(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]'), 1) AS i FROM d),
w AS (SELECT d, lang, i, d::VARCHAR || '/' || i AS p, unnest(regexp_extract_all(piece, '[^\\x20\\x09]+')) AS word, generate_subscripts(regexp_extract_all(piece, '[^\\x20\\x09]+'), 1) AS j FROM s),
g AS (SELECT lang, word, unnest([word, {_PHRASES}]) AS phrase FROM w WINDOW w AS (ORDER BY d, i, j)),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE contains(phrase, ' ')),
cuts AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(x))) AS k FROM c) c JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(x[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(x[k + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT c.lang, s.phrase FROM (SELECT lang, a, x, unnest(range(1, len(x))) AS i FROM c) c, LATERAL (SELECT unnest(range(i + 1, len(x) + 1)) AS j) e,
  LATERAL (SELECT array_to_string(x[i:j], ' ') AS phrase, j - i + 1 AS m) s JOIN f ON f.lang = c.lang AND f.phrase = s.phrase WHERE s.m < len(x) AND 100 * c.a >= 100 * f.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM low JOIN n USING (lang) ANTI JOIN inside USING (lang, phrase) QUALIFY rank <= {TOP}
"""

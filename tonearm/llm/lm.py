"""Context-tree weighting over bytes (operator 10).

A text is modelled as its lower-cased words joined by single spaces and ended
by a line feed, so its probability is that of its tokens and their end.  Each
byte is eight binary decisions; a decision's node is the context of d preceding
bytes together with the bits already known.  At every depth the node has a
Krichevsky-Trofimov estimate; the weight of staying at a node against going on
to the longer context is the posterior half-and-half mixture of the tree,
P_w = (P_kt + product of the children's P_w) / 2.  Below the last context that
training has seen, the estimate of that last one stands.

Training needs counts alone: the byte n-grams of all training texts.  The tree
has the same depth at every size of corpus and is never in one place: n-grams
are dealt by the last two bytes of their contexts, those of crowded contexts by
three, into parts whose number follows from the counts; each task weighs the
subtrees below its contexts, and only the nodes of one byte of context or none
and those of the crowded contexts (fewer than 256) are gathered.  The probabilities of the commonest n-grams (a bounded table) are
broadcast; the rest of a text's n-grams meet theirs in a join.

The base score is the add-one unigram of the words; its commonest words are
broadcast and its rest joined in the same way.

Defined results: a null or empty text is its end alone; rows with a null id
are learned and scored under the empty id; repeated rows have a result each;
an empty training set scores every decision one half; a text of any length is
scored whole, and no probability is ever nought.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, materialized, packed, pieces, texts_of, unpacked

DEPTH = 5
#: Bytes of context by which n-grams are dealt.
TOP = 2
#: A context with more than this part of all counted n-grams is crowded.
CROWDED = 256
#: N-grams of a part, before those of several mappers are added up.
PART_GRAMS = 4_000_000
#: The most n-grams that are broadcast (12 bytes each).
COMMON_GRAMS = 2_000_000
COMMON_WORDS = 100_000
FOLDS, HELD = 7, 2
_HELD_WORDS, _HELD_GRAMS = 400_000, 1 << 20
U = np.uint64


def words_of(text: str) -> list[bytes]:
    """A-Z lowered in UTF-8, split at the six ASCII spaces."""
    return text.encode().lower().split()


def coded(lines: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram (depth bytes of context and a byte) at each place of each line, and where each line starts.

    Before its start a line has zero bytes."""
    data = np.frombuffer(b"".join(bytes(depth) + x for x in lines), np.uint8).astype(U)
    gram = data[depth:].copy()
    for j in range(1, depth + 1):
        gram |= data[depth - j : len(data) - j] << U(8 * j)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    keep = np.ones(len(gram), bool)
    for j in range(depth):
        keep[starts[1:] - depth + j] = False  # the zero bytes between lines
    return gram[keep], np.cumsum(sizes) - sizes


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument to eight or more."""
    shift = np.zeros_like(x)
    y = x.copy()
    while (low := y < 8).any():
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT block probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)


def node(gram: np.ndarray, d: int, k: int) -> np.ndarray:
    """Context of d bytes, then a one and the first k bits of the byte."""
    byte = gram & U(255)
    context = (gram >> U(8)) & U((1 << 8 * d) - 1)
    return context << U(8) | U(1 << k) | byte >> U(8 - k)


def estimates(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probabilities of a zero and of a one; neither is ever nought."""
    return np.stack([zero + 0.5, one + 0.5]) / (zero + one + 1)


class Subtrees:
    """The nodes with ``top`` or more bytes of context below some contexts of ``top`` bytes, whole.

    For d bytes of context and k known bits: key[d, k] (sorted), their place in the level above, the estimates, and the
    weight of staying and of going on."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, top: int = TOP):
        self.depth, self.top = depth, top
        self.key, self.up, self.kt, self.stay, self.go = {}, {}, {}, {}, {}
        #: log of the weighted probability of each node with ``top`` bytes of context.
        self.weighted: list[np.ndarray] = []
        levels = {}
        for d in range(depth, top - 1, -1):
            if d < depth:
                grams, back = np.unique(grams & U((1 << 8 * (d + 1)) - 1), return_inverse=True)
                counts = np.bincount(back, counts, len(grams))
            levels[d] = grams, counts.astype(np.float64)
        for k in range(8):
            sums = {}
            for d, (own, n) in levels.items():
                key = node(own, d, k)  # as sorted as the n-grams
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                bit = (own >> U(7 - k)) & U(1) == 1
                self.key[d, k] = key[first]
                sums[d] = [np.add.reduceat(n * x, first) if len(first) else n for x in (~bit, bit)]
            below = None
            for d in range(depth, top - 1, -1):
                self.kt[d, k] = estimates(*sums[d])
                weighted = kt_log(*sums[d])
                if d < depth:
                    both = np.logaddexp(weighted, below)
                    self.stay[d, k], self.go[d, k] = np.exp(weighted - both), np.exp(below - both)
                    weighted = both - math.log(2)
                if d > top:
                    # A child has one byte more of context in front; its parent is the key without that byte.
                    self.up[d, k] = np.searchsorted(self.key[d - 1, k], self.key[d, k] & U((1 << 8 * d) - 1))
                    below = np.bincount(self.up[d, k], weighted, len(self.key[d - 1, k]))
            self.weighted.append(weighted)

    def above(self) -> tuple[np.ndarray, np.ndarray]:
        """The nodes with a byte less than ``top``, and what their children here add to the log of theirs."""
        own = np.concatenate([self.key[self.top, k] & U((1 << 8 * self.top) - 1) for k in range(8)])
        key, back = np.unique(own, return_inverse=True)
        return key, np.bincount(back, np.concatenate(self.weighted), len(key))

    def log2(self, grams: np.ndarray, top: Top) -> np.ndarray:
        """log2 of the probability of each n-gram's last byte after its context."""
        out = np.zeros(len(grams))
        for k in range(8):
            bit = ((grams >> U(7 - k)) & U(1)).astype(np.int64)
            p = top.ends(node(grams, self.top - 1, k), bit, self.top - 1)
            mixed, left = None, None
            for d in range(self.top, self.depth + 1):
                own = self.key[d, k]
                if not len(own):
                    break
                if d == self.top:
                    mixed, left = top.passes(own & U((1 << 8 * self.top) - 1), self.top - 1)
                else:
                    at = self.up[d, k]
                    mixed, left = (mixed + left * self.stay[d - 1, k] * self.kt[d - 1, k])[:, at], (left * self.go[d - 1, k])[at]
                key = node(grams, d, k)
                place = np.minimum(np.searchsorted(own, key), len(own) - 1)
                hit = own[place] == key
                place = place[hit]
                p[hit] = mixed[bit[hit], place] + left[place] * self.kt[d, k][bit[hit], place]
            out += np.log2(p)
        return out


def node_counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 256 nodes of each context (places 1 to 255), from the counts of each byte after it."""
    zero, one = np.zeros((len(n), 256)), np.zeros((len(n), 256))
    for k in range(8):
        parted = n.reshape(len(n), 1 << k, 2, 128 >> k).sum(-1)
        zero[:, 1 << k : 2 << k], one[:, 1 << k : 2 << k] = parted[..., 0], parted[..., 1]
    return zero.ravel(), one.ravel()


class Top:
    """The nodes of no and of one byte of context (256 and 65,536 at most), by their keys, and those of crowded contexts of two
    bytes (256 each)."""

    def __init__(self, counts: np.ndarray, below: np.ndarray, crowded: np.ndarray | None = None, crowded_counts: np.ndarray | None = None, crowded_below: np.ndarray | None = None):
        """counts: of each byte after each byte (65,536); below: by node, what its children add to the log, but those of crowded
        contexts, which are given in order with the same two of their own (256 each)."""
        self.seen, kt, ways = [], [], []
        crowded = np.zeros(0, np.int64) if crowded is None else crowded
        own = np.zeros((0, 256)) if crowded_counts is None else crowded_counts.reshape(-1, 256)
        for n in (counts.reshape(256, 256).sum(0)[None], counts.reshape(256, 256), own):
            zero, one = node_counts(n)
            self.seen.append(zero + one > 0)
            kt.append(estimates(zero, one))
            ways.append(kt_log(zero, one))
        #: Where the nodes of a context of two bytes begin, and the node of one byte above each of them.
        self.place = np.full(65536, -1)
        self.place[crowded] = 256 * np.arange(len(crowded))
        parent = ((crowded & 255)[:, None] << 8 | np.arange(256)).ravel()
        last = np.zeros(0) if crowded_below is None else crowded_below
        both = np.logaddexp(ways[2], last)
        stay, go = [None, None, np.exp(ways[2] - both)], [None, None, np.exp(last - both)]
        below = below + np.bincount(parent, np.where(self.seen[2], both - math.log(2), 0), 65536)
        both = np.logaddexp(ways[1], below)
        stay[1], go[1] = np.exp(ways[1] - both), np.exp(below - both)
        root = np.where(self.seen[1], both - math.log(2), 0).reshape(256, 256).sum(0)
        both = np.logaddexp(ways[0], root)
        stay[0], go[0] = np.exp(ways[0] - both), np.exp(root - both)
        #: By bytes of context: the probability where a path ends there, and what one that goes on has gathered.
        self.end, self.mixed, self.left = [kt[0]], [stay[0] * kt[0]], [go[0]]
        for d, above in ((1, np.arange(65536) & 255), (2, parent)):
            mixed, left = self.mixed[-1][:, above], self.left[-1][above]
            self.end.append(mixed + left * kt[d])
            self.mixed.append(mixed + left * stay[d] * kt[d])
            self.left.append(left * go[d])

    def at(self, key: np.ndarray, d: int) -> np.ndarray:
        return self.place[key >> 8] + (key & 255) if d == 2 else key

    def ends(self, key: np.ndarray, bit: np.ndarray, d: int = TOP - 1) -> np.ndarray:
        key = key.astype(np.int64)
        out = 0.5
        for n in range(d + 1):
            own = self.at(key & (256 << 8 * n) - 1, n)
            out = np.where(self.seen[n][own], self.end[n][bit, own], out)
        return out

    def passes(self, key: np.ndarray, d: int = TOP - 1) -> tuple[np.ndarray, np.ndarray]:
        own = self.at(key.astype(np.int64), d)
        return self.mixed[d][:, own], self.left[d][own]


class Memo:
    """An open-addressing table from n-grams to their log2 probabilities."""

    MIX = U(0x9E3779B97F4A7C15)

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(2.2 * max(1, len(grams))).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, ~U(0))
        self.value = np.zeros(size, np.float32)
        slot = self.slot(grams)
        rest = np.arange(len(grams))
        while len(rest):
            free = rest[self.key[slot[rest]] == ~U(0)]
            self.key[slot[free]] = grams[free]  # of several the last stays
            won = free[self.key[slot[free]] == grams[free]]
            self.value[slot[won]] = values[won]
            done = np.zeros(len(grams), bool)
            done[won] = True
            rest = rest[~done[rest]]
            slot[rest] = (slot[rest] + 1) & (size - 1)

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * self.MIX) >> U(64 - self.bits)).astype(np.int64)

    def log2(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values (zero where there is none), and the places of the n-grams that it doesn't have."""
        slot = self.slot(grams)
        key = self.key[slot]
        out = self.value[slot].astype(np.float64)
        rest = np.flatnonzero(key != grams)
        out[rest] = 0
        lost = [np.zeros(0, np.int64)]
        while len(rest):
            empty = self.key[slot[rest]] == ~U(0)
            lost.append(rest[empty])
            rest = rest[~empty]
            slot[rest] = (slot[rest] + 1) & (len(self.key) - 1)
            hit = self.key[slot[rest]] == grams[rest]
            out[rest[hit]] = self.value[slot[rest[hit]]]
            rest = rest[~hit]
        return out, np.concatenate(lost)


class Shared:
    """What is broadcast; each Python process builds its table from it once."""

    def __init__(self, grams: np.ndarray, values: np.ndarray, common: dict[bytes, int]):
        self.grams, self.values, self.common = grams, values, common
        self.memo: Memo | None = None

    def table(self) -> Memo:
        if self.memo is None:
            self.memo = Memo(self.grams, self.values)
        return self.memo


def added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[first], np.add.reduceat(n, first) if len(first) else n


def gram_table(docs: DataFrame, depth: int = DEPTH, crowd: int = CROWDED) -> DataFrame:
    """(gram, n, log2p) of every n-gram of the texts: how often the texts with ``train`` have it, and its probability.

    N-grams are dealt by the last TOP bytes of their contexts, below which each task has whole subtrees.  What lies above
    them is summed by node, at most 65,536 of them.  Each task adds up its own counts before they are dealt.

    A context with over one ``crowd``-th of what is dealt is dealt by a byte more (it has 2^24 n-grams of each at most), and its
    nodes are summed too: fewer than ``crowd`` contexts of 256 nodes."""
    if not TOP <= depth <= 5:
        raise ValueError("depth must be from 2 to 5")
    sent = pa.schema([("context", pa.int64()), ("rest", pa.binary()), ("n", pa.binary())])
    held = pa.schema([("kind", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("x", pa.float64())])

    def out(code, n):
        context = code >> U(32)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(code)])
        rows = [(int(context[i]), packed(np.diff(code[i:j] & U(0xFFFFFFFF), prepend=U(0))), packed(n[i:j])) for i, j in zip(first.tolist(), np.append(first[1:], len(code)).tolist(), strict=False)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent)

    def count(batches):
        code, counts, size = np.zeros(0, U), np.zeros(0, np.int64), 0
        for batch in pieces(batches, 1 << 20):  # an n-gram takes eight bytes, some times over
            lines = [b" ".join(words_of(x)) + b"\n" for x in texts_of(batch)]
            train = np.array(batch.column("train").to_pylist(), bool)
            for now in (True, False):
                grams, _ = coded([x for x, t in zip(lines, train, strict=True) if t == now], depth)
                for at in range(0, len(grams), _HELD_GRAMS):
                    new, n = np.unique(grams[at : at + _HELD_GRAMS], return_counts=True)
                    # The last TOP bytes of context in the upper half; the older ones and the byte in the lower.
                    new = (new >> U(8) & U(0xFFFF)) << U(32) | new >> U(8 * TOP + 8) << U(8) | new & U(255)
                    code, counts = added(np.concatenate([code, new]), np.concatenate([counts, n * now]))
                    size += _HELD_GRAMS
            if len(code) > _HELD_GRAMS or size > 1 << 31:  # counts are sent in 32 bits
                yield from out(code, counts)
                code, counts, size = code[:0], counts[:0], 0
        yield from out(code, counts)

    def parted(batches):
        for batch in batches:
            made = []
            for context, rest, n in zip(batch.column("context").to_pylist(), batch.column("rest").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if not crowded[context]:
                    made.append((context, rest, n))
                    continue
                code, counts = np.cumsum(unpacked(rest), dtype=U), unpacked(n)
                third = code >> U(8) & U(255)
                for x in np.unique(third).tolist():
                    own = third == x
                    made.append((context | (x + 1) << 16, packed(np.diff(code[own], prepend=U(0))), packed(counts[own])))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), sent, strict=True)], schema=sent)

    def merge(batches):
        held = [([np.zeros(0, U)], [np.zeros(0, np.int64)]) for _ in range(2)]
        for batch in batches:
            for context, rest, n in zip(batch.column("context").to_pylist(), batch.column("rest").to_pylist(), batch.column("n").to_pylist(), strict=True):
                codes, counts = held[context >> 16 > 0]
                codes.append(np.cumsum(unpacked(rest), dtype=U) | U((context & 0xFFFF) << 32))
                counts.append(unpacked(n).astype(np.int64))
        for top, (codes, counts) in enumerate(held, TOP):
            code, n = added(np.concatenate(codes), np.concatenate(counts))
            codes.clear(), counts.clear()
            gram = code >> U(32) << U(8) | code & U(255) | (code & U(0xFFFFFF00)) << U(8 * TOP)
            order = np.argsort(gram)
            gram, n = gram[order], n[order]
            yield from rows(0, gram, n)
            seen, times = gram[n > 0], n[n > 0].astype(np.float64)
            # Its byte after one byte of context (and after two), and the subtrees' share in the nodes above them.
            for kind, bytes_ in ((1, 2), (3, 3))[: top - 1]:
                low, back = np.unique(seen & U((1 << 8 * bytes_) - 1), return_inverse=True)
                yield from rows(kind, low, np.bincount(back, times, len(low)).astype(np.int64))
            key, x = Subtrees(seen, times, depth, top).above() if len(seen) else (np.zeros(0, U), np.zeros(0))
            yield from rows(2 * top - 2, key, np.zeros(len(key), np.int64), x)

    def rows(kind, key, n, x=None):
        x = np.zeros(len(key)) if x is None else x
        for at in range(0, len(key), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[cut]), kind, np.int64)), pa.array(key[cut].view(np.int64)), pa.array(n[cut]), pa.array(x[cut])], schema=held)

    ddl = "context long, rest binary, n binary"
    counted = materialized(docs.select("text", "train").mapInArrow(count, ddl))
    sizes = counted.groupBy("context").agg((F.sum(F.octet_length("rest").cast("long")) / 4).alias("grams"))
    all_ = counted.agg(F.coalesce(F.sum(F.octet_length("rest").cast("long")) / 4, F.lit(0.0))).first()[0]
    crowded = np.zeros(65536, bool)
    if depth > TOP:
        crowded[sizes.where(F.col("grams") * crowd > all_).select("context").toArrow().column("context").to_numpy()] = True
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(all_ / PART_GRAMS))
    met = materialized(counted.mapInArrow(parted, ddl).repartition(parts, "context").mapInArrow(merge, "kind long, key long, n long, x double"))
    sums = met.where("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
    kind, key, n, x = (sums.column(c).to_numpy() for c in ("kind", "key", "n", "x"))
    own = np.flatnonzero(crowded)
    place = np.full(65536, -1)
    place[own] = 256 * np.arange(len(own))
    at = lambda k: place[key[kind == k] >> 8] + (key[kind == k] & 255)  # noqa: E731  of a crowded context
    counts, below, crowded_counts, crowded_below = np.zeros(65536), np.zeros(65536), np.zeros(256 * len(own)), np.zeros(256 * len(own))
    counts[key[kind == 1]], below[key[kind == 2]] = n[kind == 1], x[kind == 2]
    crowded_counts[at(3)], crowded_below[at(4)] = n[kind == 3], x[kind == 4]
    top = docs.sparkSession.sparkContext.broadcast(Top(counts, below, own, crowded_counts, crowded_below))

    def weigh(batches):
        grams, n = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for batch in batches:
            grams.append(batch.column("key").to_numpy().view(U))
            n.append(batch.column("n").to_numpy())
        grams, n = np.concatenate(grams), np.concatenate(n)
        deep = crowded[(grams >> U(8) & U(0xFFFF)).astype(np.int64)]
        for first, chosen in ((TOP, ~deep), (TOP + 1, deep)):
            whole, times = grams[chosen], n[chosen]
            if not len(whole):
                continue
            tree = Subtrees(whole[times > 0], times[times > 0].astype(np.float64), depth, first)
            for at in range(0, len(whole), 100_000):
                own = whole[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(times[at : at + 100_000]), pa.array(tree.log2(own, top.value))], names=["gram", "n", "log2p"])

    # The checkpoint's parts are those of the exchange, so subtrees are whole here too.
    return materialized(met.where("kind = 0").select("key", "n").mapInArrow(weigh, "gram long, n long, log2p double"))


def commonest(grams: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The n-grams of the highest counts, ``most`` at most, and the others."""
    step = F.floor(8 * F.log2(F.col("n") + 1.0)).cast("int")
    held = {r["step"]: r["rows"] for r in grams.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()}  # a few hundred steps
    least, total = max(held, default=0) + 1, 0
    for own in sorted(held, reverse=True):
        total += held[own]
        if total > most:
            break
        least = own
    return grams.where(step >= least), grams.where(step < least)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts; words are bytes."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def out(counts):
        items = list(counts.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], schema=schema)

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in pieces(batches, 4 << 20):
            for x in texts_of(batch, text):
                counts.update(words_of(x))
                if len(counts) > _HELD_WORDS:
                    yield from out(counts)
                    counts.clear()
        yield from out(counts)

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lm_scores(docs: DataFrame, depth: int = DEPTH, common_grams: int = COMMON_GRAMS, common_words: int = COMMON_WORDS) -> DataFrame:
    """Base and context-tree scores of every text; learns from those outside the held-out fold."""
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    held = crc_of_id() % FOLDS == HELD
    training = own.where(~held)
    grams = gram_table(own.select("text", (~held).alias("train")), depth)
    near, far = commonest(grams, common_grams)
    near = near.select("gram", F.col("log2p").cast("float").alias("log2p")).toArrow()
    counts = materialized(word_counts(training))
    words, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = training.count()
    total, kinds = tokens + ends, words + (ends > 0)
    norm = math.log10(total + kinds + 1)
    # Bounded by the parameter; every other word meets its count in the join below.
    rank = counts.orderBy(F.desc("n"), "word").limit(common_words).toArrow()
    table = dict(zip(rank.column("word").to_pylist(), rank.column("n").to_pylist(), strict=True))
    model = spark.sparkContext.broadcast(Shared(near.column("gram").to_numpy().view(U), near.column("log2p").to_numpy(), table))
    end_score = math.log10(ends + 1) - norm
    schema = pa.schema(
        [("key", pa.binary()), ("uid", pa.int64()), ("times", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
         ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_coded", pa.int64())]
    )

    def run(batches):
        shared = model.value
        memo = shared.table()
        log = {w: math.log10(n + 1) - norm for w, n in shared.common.items()}
        uid = TaskContext.get().partitionId() << 33
        for batch in pieces(batches, 1 << 20):
            rows: list[list] = [[] for _ in range(8)]
            lines, rare_key, rare_uid, rare_times = [], [], [], []
            start = uid
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts_of(batch), strict=True):
                found = words_of(text)
                lines.append(b" ".join(found) + b"\n")
                base, known = end_score, int(ends > 0)
                for w, times in Counter(found).items():
                    if (c := log.get(w)) is not None:
                        known += times
                        base += times * c
                    else:
                        rare_key.append(b"w" + w)
                        rare_uid.append(uid)
                        rare_times.append(times)
                for column, x in zip(rows, (b"d%d" % uid, uid, doc_id, out, len(found) + 1, known, base, len(lines[-1])), strict=True):
                    column.append(x)
                uid += 1
            own, starts = coded(lines, depth)
            value, lost = memo.log2(own)
            score = np.add.reduceat(value, starts) * math.log10(2)
            # A text's n-grams that the table doesn't have, each once with its number.
            line = np.searchsorted(starts, lost, side="right") - 1
            order = np.lexsort((own[lost], line))
            line, missing = line[order], own[lost][order]
            first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (missing[1:] != missing[:-1]))[: len(line)])
            written = missing[first].astype(">u8").tobytes()
            rare_key += [b"g" + written[i : i + 8] for i in range(0, len(written), 8)]
            rare_uid += (start + line[first]).tolist()
            rare_times += np.diff(np.append(first, len(line))).tolist()
            n, m = len(lines), len(rare_key)
            none = lambda kind: pa.nulls(m, kind)
            whole = [rows[0], rows[1], pa.nulls(n, pa.int64()), rows[2], rows[3], rows[4], rows[5], rows[6], pa.array(score), rows[7]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(whole, schema, strict=True)], schema=schema)
            for at in range(0, m, 50_000):
                part = [pa.array(x[at : at + 50_000], f.type) for x, f in zip((rare_key, rare_uid, rare_times), schema, strict=False)]
                yield pa.RecordBatch.from_arrays(part + [none(f.type).slice(0, len(part[0])) for f in list(schema)[3:]], schema=schema)

    # A document's own row has a key that no word has, so that rows spread and one pass is enough.
    kinds_ddl = "key binary, uid long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_coded long"
    seen = own.withColumn("held_out", held).mapInArrow(run, kinds_ddl)
    c = counts.select(F.concat(F.lit(b"w"), "word").alias("key"), "n", F.lit(None).cast("double").alias("log2p"))
    c = c.unionByName(far.select(F.concat(F.lit(b"g"), F.unhex(F.lpad(F.hex("gram"), 16, "0"))).alias("key"), F.lit(None).cast("long").alias("n"), "log2p"))
    met = seen.join(c, "key", "left")
    n, is_gram = F.coalesce("n", F.lit(0)), F.col("log2p").isNotNull()
    rare = F.when(is_gram, 0.0).otherwise(F.col("times") * (F.log10(n + 1.0) - F.lit(norm)))
    out = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(n > 0, F.col("times")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", rare)).alias("base_score"), F.sum(F.coalesce("score", F.col("times") * F.col("log2p") * F.lit(math.log10(2)))).alias("score"), F.max("n_coded").alias("n_coded"),
    )
    bits = (-F.col("score") / F.lit(math.log10(2)) / F.col("n_coded")).alias("bits_per_byte")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", bits)

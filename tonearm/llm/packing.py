"""Lexical retrieval packing (operator 1).

Documents are tokenized where they are scanned and dealt by one of their rare
tokens (the one of the smallest hash), so that documents which share rare words
tend to meet; a token of very many documents is split.  Each task packs what it
gets.  Whole windows inside a long document stand alone; what is left of each
document is a unit.  Units gather in shards of bounded token count.  A shard
has a BM25 inverted index over the tokens of its units; a seed unit opens a
window, its unused neighbours fill the window in order of score, and the one
that overflows is cut and its rest seeds the next window.  The window left open
at the end of a shard goes on in the next; the last of a partition is cut into
sequences of power-of-two lengths, which need no padding.

Defined results: a null or empty text is the end token alone; a null doc_id
is kept; repeated rows are packed once each; texts of any length are packed
whole; units with equal scores go in their order; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pieces, ragged, texts_of

WINDOW = 1024
END_ID = 0
K1, B = 1.2, 0.75
#: Tokens from here on are rare: a vocabulary of merges has the common ones first.
RARE = 20_000

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """Ids as the tokenizers library gives them for ``name``.json.

    The .tiktoken file holds the same vocabulary as ranks, and its library is
    five times as fast; the special string is taken as a token by both.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    slow: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special=allowed)
        except ValueError:  # its pattern gives up on runs of very many spaces; the other library's doesn't
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


class Shard:
    """An inverted index with BM25 weights over a bounded block of units."""

    def __init__(self, units: list[np.ndarray]):
        n = self.n = len(units)
        lengths = np.array([len(u) for u in units], np.int64)
        keys = np.repeat(np.arange(n, dtype=np.int64) << 32, lengths) | np.concatenate(units).astype(np.int64)
        keys, tf = np.unique(keys, return_counts=True)
        unit, term = keys >> 32, keys & 0xFFFFFFFF
        order = np.argsort(term, kind="stable")
        terms, first, df = np.unique(term[order], return_index=True, return_counts=True)
        # Robertson's idf, no less than zero: what half the units have tells nothing.
        idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        at = np.searchsorted(terms, term)
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        weight = (idf[at] * tf * (K1 + 1) / (tf + norm[unit])).astype(np.float64)
        self.posting_unit, self.posting_weight = unit[order], weight[order]
        told = idf[at] > 0
        self.first, self.df = first, df
        self.unit_terms = at[told]
        self.unit_at = np.searchsorted(unit[told], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.unit_terms[self.unit_at[seed] : self.unit_at[seed + 1]]
        i = ragged(self.first[terms], self.df[terms])
        return np.bincount(self.posting_unit[i], self.posting_weight[i], self.n)


class Packer:
    """Takes documents one by one; gives (doc, start, sequence, offset, ids) pieces."""

    def __init__(self, first_sequence: int, window: int = WINDOW, shard_tokens: int = 1 << 19):
        self.window, self.shard_tokens, self.sequence = window, shard_tokens, first_sequence
        self.units: list[tuple[object, int, np.ndarray]] = []
        self.held = 0
        self.open: list[tuple[object, int, np.ndarray]] = []  # the window not yet full
        self.filled = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            yield doc, at, self.sequence, 0, ids[at : at + self.window]
            self.sequence += 1
        if whole < len(ids):
            self.units.append((doc, whole, ids[whole:]))
            self.held += len(ids) - whole
            if self.held >= self.shard_tokens:
                yield from self.flush()

    def _place(self, doc: object, start: int, ids: np.ndarray) -> Iterator[tuple]:
        """Into the open window; what doesn't fit opens the next."""
        while len(ids):
            part = ids[: self.window - self.filled]
            self.open.append((doc, start, part))
            self.filled += len(part)
            ids, start = ids[len(part) :], start + len(part)
            if self.filled == self.window:
                yield from self._close(self.window)

    def _close(self, length: int) -> Iterator[tuple]:
        """The next ``length`` ids of the open pieces become a sequence."""
        offset, rest = 0, []
        for doc, start, ids in self.open:
            part = ids[: length - offset]
            if len(part):
                yield doc, start, self.sequence, offset, part
            if len(part) < len(ids):
                rest.append((doc, start + len(part), ids[len(part) :]))
            offset += len(part)
        self.sequence += 1
        self.open, self.filled = rest, self.filled - length

    def flush(self) -> Iterator[tuple]:
        """Packs the shard."""
        units, self.units, self.held = self.units, [], 0
        if not units:
            return
        index = Shard([u[2] for u in units])
        unused = np.ones(len(units), bool)
        ahead = 0
        last = None  # the unit whose rest lies in the open window
        while True:
            while ahead < len(units) and not unused[ahead]:
                ahead += 1
            if ahead == len(units):
                return
            if not self.filled or last is None:
                last = ahead
                unused[last] = False
                yield from self._place(*units[last])
                if not self.filled:
                    continue
            free = np.flatnonzero(unused)
            score = index.scores(last)[free]
            need = self.window - self.filled
            # A unit has at least one id, so no more than `need` neighbours fill the window.
            if len(free) > 64:
                near = np.argpartition(-score, 63)[:64]
                near = near[np.lexsort((near, -score[near]))]
                if sum(len(units[free[k]][2]) for k in near) < need:
                    near = np.lexsort((np.arange(len(score)), -score))
            else:
                near = np.lexsort((np.arange(len(score)), -score))
            for k in free[near]:
                unused[k] = False
                yield from self._place(*units[k])
                need -= len(units[k][2])
                if need <= 0:
                    last = int(k)
                    break

    def finish(self) -> Iterator[tuple]:
        yield from self.flush()
        while self.filled:
            yield from self._close(1 << (self.filled.bit_length() - 1))


def route(ids: np.ndarray) -> int:
    """The rare token of the smallest hash, or of all if none is rare; documents that share it meet."""
    kinds = np.unique(ids)
    rare = kinds[kinds >= RARE] if kinds[-1] >= RARE else kinds
    return int(rare[((rare.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).argmin()])


def pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = 1 << 19) -> DataFrame:
    """One row per piece of a document, with its token ids as little-endian uint32."""
    coded = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def tokenize(batches):
        encode = byte_bpe()
        end = np.array([END_ID], "<u2")  # the vocabulary has less than 65,536 ids
        for batch in pieces(batches, 4 << 20):
            ids = [np.concatenate([encode(x).astype("<u2"), end]) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([route(x) for x in ids], pa.int64()), batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary())], schema=coded)

    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 33, window, shard_tokens)
        out: list[list] = [[] for _ in _ARROW]
        size = 0

        def ready():
            nonlocal out, size
            made = pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
            out, size = [[] for _ in _ARROW], 0
            return made

        def put(found):
            nonlocal size
            for (doc_id, total), start, sequence, offset, ids in found:
                for column, x in zip(out, (doc_id, start, len(ids), total, sequence, offset, ids.astype("<u4").tobytes()), strict=True):
                    column.append(x)
                size += 4 * len(ids) + 64
                if size > 4 << 20:
                    yield ready()

        for batch in pieces(batches, 8 << 20):
            for doc_id, held in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(held, "<u2")
                yield from put(packer.add((doc_id, len(ids)), ids))
        yield from put(packer.finish())
        if out[0]:
            yield ready()

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tokenize, "key long, doc_id long, ids binary")
    return own.hint("rebalance", "key").sortWithinPartitions("key", "doc_id").mapInArrow(run, SCHEMA)

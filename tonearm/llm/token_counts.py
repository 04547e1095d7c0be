"""Token counts by byte-pair merging without identifiers (operator 2).

A piece of text starts as a linked list of symbols; a heap holds the adjacent
pairs that have a merge rank.  Popping the lowest rank (the leftmost of equals)
and joining its two symbols is repeated until no pair is left.  The piece's
token count is its initial symbols minus the merges.

Defined results: a null or empty text has no tokens; rows map one to one, so
null ids, repeated rows and empty tables pass through; a text of any length is
counted whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
#: The vocabulary's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Letters whose small forms are newer than Python's tables.
SMALL = {0xA7CB: 0x264, 0xA7DC: 0x19B}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class MergeCounter:
    """Counts the tokens of texts under one merge list."""

    def __init__(self, path: str, memo_entries: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.rank = {tuple(pair): i for i, pair in enumerate(spec["model"]["merges"])}
        self.symbol = byte_symbols()
        self.special = regex.compile("|".join(map(regex.escape, sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True))))
        self.special_words = [x["content"] for x in spec["added_tokens"]]
        self.pattern = regex.compile(PATTERN)
        self.memo_entries = memo_entries
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Initial symbols minus merges of one piece."""
        own = [self.symbol[b] for b in text.encode()]
        n = len(own)
        own[-1] += self.suffix
        if n == 1:
            return 1
        rank = self.rank
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((own[i], own[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            if own[i] is None or (j := after[i]) == n or rank.get((own[i], own[j])) != r:
                continue  # one of its symbols has gone into another merge
            own[i], own[j] = own[i] + own[j], None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((own[i], own[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank.get((own[k], own[i]))) is not None:
                heapq.heappush(heap, (r, k))
        return n - merges

    def chunk(self, text: str) -> int:
        """Tokens of a stretch without spaces."""
        total = 0
        for word in self.pattern.findall(text):
            if len(word) > 40:
                total += self.piece(word)
                continue
            n = self.words.get(word)
            if n is None:
                n = self.words[word] = self.piece(word)
            total += n
        return total

    def plain(self, text: str) -> int:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.translate(SMALL).replace("Σ", "σ")  # each character is lowered by itself, without a final form
        total = 0
        chunks = self.chunks
        for part, times in Counter(text.lower().replace("\n", " ").split(" ")).items():
            n = chunks.get(part)
            if n is None:
                n = self.chunk(part)
                if len(part) <= 40:
                    chunks[part] = n
            total += n * times
        for memo in (self.chunks, self.words):
            if len(memo) > self.memo_entries:
                memo.clear()
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; special strings in it count one each."""
        if not any(x in text for x in self.special_words):
            return self.plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each text."""

    def run(batches):
        import public_tokenizers

        counter = MergeCounter(public_tokenizers.path(vocabulary))
        for batch in pieces(batches):
            texts = texts_of(batch)
            counts = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                schema=_ARROW,
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)

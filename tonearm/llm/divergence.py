"""Source divergence audit by sort-based streaming (operator 12).

Which sources of a language use other words than the rest?  Mappers take the
terms of each document, sort them by (lang, term, source, document) and scan
the runs into partial runs (documents and occurrences by source).  Those are
repartitioned by (lang, term) and sorted again by (lang, term, source,
document), and one run-length scan gives each term's document frequency and its
counts by source.  A term's run holds a partial run per source and mapper's
block and not one per document, so no common word is a hot key.

The kept terms' runs are then dealt by pairs of blocks of sources and by slices
of the terms.  A header names the sources of both blocks and what their shares
are made of; the scan of a slice emits partial sums of |p - q| for each pair of
sources and the best terms of each source, which are summed and ranked.  A term
that neither block has adds the same to all, so the header counts it for the
whole language and the runs correct that.  Nothing is broadcast; a task
holds two blocks of sources and a thousand terms, whatever the size of the
input.  Shares are floors by long division, which passes no 64 bits while a
language has fewer than 9 x 10^15 occurrences.

Defined results: null texts, languages and sources count as empty texts; each
row is a document of its own, repeated or not, and its id is not read; a text of
any length counts whole; ties go by the item's UTF-8 bytes; a language without
kept terms has pairs of value 0; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized, pieces

MIN_DOCS, TOP, SMOOTHING = 30, 50, 5
#: Sources of a block (on average), kept terms of a slice, terms held at once, partial runs merged at once.
BLOCK, SLICE, HELD, MERGED = 128, 1 << 11, 1024, 1 << 20

#: Letters stay (A-Z as a-z) and so does what is beyond ASCII; the rest parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("docs", pa.int64()), ("count", pa.int64())])
RUNS = "lang string, term string, source string, document long, docs long, count long"


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def term_runs(langs: list[str], sources: list[str], texts: list[bytes], first: int) -> pa.Table:
    """The partial runs of a block of documents, numbered from ``first``."""
    lang, source = pa.array(langs, pa.string()).dictionary_encode(), pa.array(sources, pa.string()).dictionary_encode()
    words: list[bytes] = []
    sizes = []
    for x in texts:
        own = x.translate(_TERMS).split()
        sizes.append(len(own))
        words += own
    term = pa.array(words, pa.binary()).dictionary_encode()
    del words
    document = np.repeat(np.arange(len(texts)), sizes)
    t = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of_lang, of_source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, source))
    # Secondary sort: (lang, term) and (source, document) as two numbers.
    major = of_lang[document] * max(1, len(term.dictionary)) + t
    minor = of_source[document] * max(1, len(texts)) + document
    order = np.lexsort((minor, major))
    major, minor, document = major[order], minor[order], document[order]
    # Runs of a document, and runs of a source in these.
    at = starts(major, minor)
    counts = np.diff(np.append(at, len(major)))
    major, document = major[at], document[at]
    at = starts(major, of_source[document])
    docs = np.diff(np.append(at, len(major)))
    counts = np.add.reduceat(counts, at) if len(at) else counts
    major, document = major[at], document[at]
    return pa.table(
        [
            lang.dictionary.take(pa.array(major // max(1, len(term.dictionary)))), term.dictionary.take(pa.array(major % max(1, len(term.dictionary)))).cast(pa.string()),
            source.dictionary.take(pa.array(of_source[document])), pa.array(document + first), pa.array(docs, pa.int64()), pa.array(counts, pa.int64()),
        ],
        schema=_RUNS,
    )


def merged(tables: list[pa.Table]) -> pa.Table:
    """Partial runs of several blocks as one run each."""
    if len(tables) == 1:
        return tables[0]
    out = pa.concat_tables(tables).group_by(["lang", "term", "source"]).aggregate([("document", "min"), ("docs", "sum"), ("count", "sum")])
    return pa.table([out["lang"], out["term"], out["source"], out["document_min"], out["docs_sum"], out["count_sum"]], schema=_RUNS)


def map_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    first = rows = 0
    for batch in pieces(batches):
        texts = [x or b"" for x in batch.column("text").to_pylist()]
        held.append(term_runs(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, first))
        first += len(texts)
        rows += held[-1].num_rows
        if rows > MERGED:
            held = [merged(held)]
            if held[0].num_rows > MERGED // 2:  # merging doesn't shrink them any more
                yield from held[0].to_batches(max_chunksize=1 << 16)
                held = []
            rows = sum(x.num_rows for x in held)
    if held:
        yield from merged(held).to_batches(max_chunksize=1 << 16)


_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def scan_runs(min_docs: int):
    """A scan of sorted partial runs: document frequency and counts of each term in at least ``min_docs`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is open: a term, and its sources with their counts so far.
        tail: tuple[str, str] | None = None
        docs, sources, counts = 0, [], []
        out: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, source = (batch.column(c).dictionary_encode() for c in ("lang", "term", "source"))
            codes = [x.indices.to_numpy(zero_copy_only=False) for x in (lang, term, source)]
            at = starts(*codes)
            n, c = (np.add.reduceat(batch.column(x).to_numpy(), at) for x in ("docs", "count"))
            heads = starts(codes[0][at], codes[1][at])
            ends = np.append(heads[1:], len(at))
            names = source.dictionary.to_pylist()
            languages, terms = lang.dictionary.to_pylist(), term.dictionary.to_pylist()
            of_source = codes[2][at]
            total = np.add.reduceat(n, heads)
            for i, (a, b) in enumerate(zip(heads, ends, strict=True)):
                key = (languages[codes[0][at[a]]], terms[codes[1][at[a]]])
                if key != tail:
                    if tail is not None and docs >= min_docs:
                        out.append((*tail, docs, sources, counts))
                    tail, docs, sources, counts = key, 0, [], []
                elif sources and sources[-1] == names[of_source[a]]:
                    counts[-1] += int(c[a])
                    a += 1
                docs += int(total[i])
                if a < b:
                    sources += [names[s] for s in of_source[a:b]]
                    counts += c[a:b].tolist()
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _KEPT, strict=True)], schema=_KEPT)
                    out = []
        if tail is not None and docs >= min_docs:
            out.append((*tail, docs, sources, counts))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _KEPT, strict=True)], schema=_KEPT)

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, docs, sources and counts (those with any) of each term in at least ``min_docs`` documents of its language."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    runs = docs.select(text("lang"), text("source"), docs["text"].cast("binary").alias("text")).mapInArrow(map_runs, RUNS)
    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.mapInArrow(scan_runs(min_docs), "lang string, term string, docs long, sources array<string>, counts array<long>")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * count / total) of counts up to the total, three digits at a time."""
    left, out = count.astype(np.int64), np.zeros(np.shape(count), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
PARTS = "lang string, source string, part string, item string, value long"


class Slice:
    """The scan of one slice of terms against one pair of blocks."""

    def __init__(self, head: dict, smoothing: int, top: int):
        self.key, self.lang, self.same, self.smoothing, self.top = (head["lang"], head["a"], head["b"], head["part"]), head["lang"], head["a"] == head["b"], smoothing, top
        self.v, self.first = head["v"], head["part"] == 0
        self.sides = []
        for names, totals in ((head["a_sources"], head["a_totals"]), (head["b_sources"], head["b_totals"])):
            below = np.array(totals, np.int64) + smoothing * self.v
            self.sides.append((names, {x: i for i, x in enumerate(names)}, below, share(np.full(len(names), smoothing), below) if self.v else np.ones(len(names), np.int64)))
        self.all = head["total"] + smoothing * self.v
        (a, _, _, pa_), (b, _, _, pb) = self.sides
        self.base = np.abs(pa_[:, None] - pb[None, :])
        self.sums = self.base * self.v if self.first else np.zeros((len(a), len(b)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in a]
        self.held: list[tuple[str, list[str], list[int]]] = []

    def add(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.held.append((term, sources, counts))
        if len(self.held) == HELD:
            self.flush()

    def shares(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        names, place, below, _ = self.sides[side]
        counts = np.zeros((len(self.held), len(names)), np.int64)
        for i, (_, sources, own) in enumerate(self.held):
            for s, c in zip(sources, own, strict=True):
                if (j := place.get(s)) is not None:
                    counts[i, j] = c
        return counts, share(counts + self.smoothing, below[None, :])

    def flush(self) -> None:
        if not self.held:
            return
        counts, p = self.shares(0)
        q = p if self.same else self.shares(1)[1]
        for i in range(p.shape[1]):
            self.sums[i] += np.abs(p[:, i : i + 1] - q).sum(0)
        self.sums -= len(self.held) * self.base
        if self.same:
            over = p - share(np.array([sum(c) for _, _, c in self.held], np.int64) + self.smoothing, self.all)[:, None]
            over[counts == 0] = 0
            for j in range(p.shape[1]):
                best = self.best[j]
                least = best[self.top - 1][0] if len(best) >= self.top else -1  # negative values, best first
                new = np.flatnonzero((over[:, j] > 0) & (-over[:, j] <= least)) if len(best) >= self.top else np.flatnonzero(over[:, j] > 0)
                if len(new):
                    best += [(-int(over[i, j]), self.held[i][0]) for i in new]
                    best.sort(key=lambda x: (x[0], x[1].encode()))
                    del best[self.top :]
        self.held = []

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        a, b = self.sides[0][0], self.sides[1][0]
        for i, x in enumerate(a):
            others = range(i + 1, len(b)) if self.same else range(len(b))
            out = [(x, "pair", b[j], int(self.sums[i, j])) for j in others]
            out += [(x, "term", t, -v) for v, t in self.best[i]]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(out)), *[pa.array(c, f.type) for c, f in zip(columns, list(_PARTS)[1:], strict=True)]], schema=_PARTS)


def scan_slices(smoothing: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Slice | None = None
        for batch in batches:
            for piece in range(0, batch.num_rows, 1024):
                for row in batch.slice(piece, 1024).to_pylist():
                    if row["a_sources"] is not None:
                        if now is not None:
                            yield from now.rows()
                        now = Slice(row, smoothing, top)
                    else:  # a pair without a header has no sources on one side
                        if now is not None and (row["lang"], row["a"], row["b"], row["part"]) == now.key:
                            now.add(row["term"], row["sources"], row["counts"])
                if now is not None:
                    now.flush()
        if now is not None:
            yield from now.rows()

    return run


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, smoothing: int = SMOOTHING, block: int = BLOCK, slice_terms: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others, and the terms that set it off."""
    kept = materialized(kept_terms(docs, min_docs))
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    groups = materialized(docs.select(text("lang"), text("source")).distinct().join(each, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")))
    langs = materialized(
        groups.groupBy("lang").agg(F.count("*").alias("n"), F.sum("total").alias("total")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").select("lang", "n", "total", F.coalesce("v", F.lit(0)).alias("v"))
    )
    most_sources, most_terms = langs.agg(F.max("n"), F.max("v")).first()
    blocks, parts = -(-(most_sources or 1) // block), -(-(most_terms or 1) // slice_terms)
    of_block = lambda s: F.pmod(F.xxhash64(s), F.lit(blocks)).cast("int")
    of_part = F.pmod(F.xxhash64(F.lit("slice"), "term"), F.lit(parts)).cast("int")
    side = groups.groupBy("lang", of_block(F.col("source")).alias("k")).agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("x"))
    side = side.select("lang", "k", F.col("x.source").alias("sources"), F.col("x.total").alias("totals"))
    # Pairs of blocks of a language, as many as the pairs of sources that go out over the square of a block.
    a, b = (side.select("lang", *[F.col(c).alias(f"{p}{d}") for c, d in (("k", ""), ("sources", "_sources"), ("totals", "_totals"))]) for p in "ab")
    heads = a.join(b, "lang").where("a <= b").join(langs, "lang").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    none = lambda t: F.lit(None).cast(t)
    columns = ["lang", "a", "b", "part", "a_sources", "a_totals", "b_sources", "b_totals", "v", "total", "term", "sources", "counts"]
    heads = heads.select(*columns[:10], none("string").alias("term"), none("array<string>").alias("sources"), none("array<long>").alias("counts"))
    own = F.array_distinct(F.transform("sources", of_block))
    ends = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(F.col("own"), j).alias("a"), F.greatest(F.col("own"), j).alias("b")))
    runs = kept.withColumn("part", of_part)
    if blocks == 1:
        runs = runs.withColumn("at", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    else:
        runs = runs.withColumn("own", F.explode(own)).withColumn("at", F.explode(ends))
        # A pair of two blocks that the term is in comes from either; the smaller one's stays.
        both = F.array_contains(F.transform("sources", of_block), F.col("at.a")) & F.array_contains(F.transform("sources", of_block), F.col("at.b"))
        runs = runs.where(~both | (F.col("own") == F.col("at.a")))
    runs = runs.select("lang", "at.a", "at.b", "part", none("array<string>").alias("a_sources"), none("array<long>").alias("a_totals"), none("array<string>").alias("b_sources"), none("array<long>").alias("b_totals"), none("long").alias("v"), none("long").alias("total"), "term", "sources", "counts")
    dealt = heads.unionByName(runs).repartition("lang", "a", "b", "part").sortWithinPartitions("lang", "a", "b", "part", F.col("term").asc_nulls_first())
    partial = dealt.mapInArrow(scan_slices(smoothing, top), PARTS)
    found = materialized(partial)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Either source has the other as an item.
    pairs = pairs.withColumn("x", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))).select("lang", "x.source", "part", "x.item", "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms)


#: DuckDB, over every group and kept term.
DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT d, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (g.total + {SMOOTHING} * vs.v))::BIGINT AS p
  FROM gn g JOIN kept k ON k.lang = g.lang JOIN vs ON vs.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
q AS (SELECT k.lang, k.term, (1 + (1000000000::HUGEINT * (coalesce(sum(c.n), 0) + {SMOOTHING})) // (any_value(ln.total) + {SMOOTHING} * any_value(vs.v)))::BIGINT AS q
  FROM kept k JOIN vs ON vs.lang = k.lang JOIN ln ON ln.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.term = k.term GROUP BY k.lang, k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}
"""

"""Sharding, source divergence and collocations against plain versions, on rows that are null, empty, very long, tied or repeated."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import collocations, divergence, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long, key long, shard int, term string, split int, slot int, count long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"{chr(97 + i % 26)}{'xyz'[i % 3] * (i % 4)}" for i in range(90)] + ["é", "Ünit", "x1y", "don't", "東京", "Big", "NEW\tyork", "a\x00b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = ["", None, "a", " \t\n", "...", "new york! new york; new york", "word " * 30_000, "é" * 9000, "a a a a a a", "same text, same text", "same text, same text"]
    texts += [" ".join(rng.choices(words, weights, k=rng.randrange(5, 120))).replace("x1y", "x1y.") for _ in range(150)]
    lang = lambda i: [None, "", "en", "en", "en", "en", "de", "fr"][i % 8]
    rows = [(i, t, lang(i), [None, "", "s1", "s2", "s3"][i * 7 % 5], 1, 2, 3, "t", 4, 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[30], rows[30], (None, "no id " * 50, None, None, *[None] * 7), (999, None, "xx", "alone", *[None] * 7), (998, None, "xx", "other", *[None] * 7)], DOC).repartition(7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_shard_slots(docs, empty):
    rows = sharding.shard_slots(docs).collect()
    own = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter({(i, len(t.encode()) + 1, zlib.crc32(t.encode())): n for (i, t), n in own.items()})
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert set(shards) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in rows}) == len({r["doc_id"] for r in rows})
    again = sharding.shard_slots(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in again) == Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in rows)
    assert sharding.shard_slots(empty).count() == 0


def ids(spark, n=40_000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("own").alias("rack"))


def where(df, tree):
    return {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in sharding.placed(df, tree).select("row.doc_id", "region", "rack", "shard").collect()}


def test_tree_shares_follow_weights(spark):
    tree = {"a": {"r": {0: 1.0, 1: 3.0}, "q": {2: 2.0}}, "b": {"r": {3: 2.0, 4: 0.0}}}
    counts = Counter(x[2] for x in where(ids(spark), tree).values())
    assert set(counts) == {0, 1, 2, 3}
    for shard, weight in {0: 1, 1: 3, 2: 2, 3: 2}.items():
        assert abs(counts[shard] / 40_000 - weight / 8) < 0.01
    with pytest.raises(ValueError):
        sharding.literal_tree({"a": {"r": {0: 0.0}}})


def test_movement_stays_in_changed_subtrees(spark):
    df, tree = ids(spark), sharding.binary_tree()
    before = where(df, tree)
    # One more shard in a region of its own takes rows only into itself, about its share, at any number of shards.
    last, at = tree, before
    for _ in range(3):
        last = sharding.grown(last)
        now = where(df, last)
        new = max(x[2] for x in now.values())
        moved = [i for i in before if now[i] != at[i]]
        assert {now[i][2] for i in moved} == {new} and abs(len(moved) / len(before) - 1 / (new + 1)) < 0.02
        at = now
    # A heavier shard: into it from its rack, into its rack from its region, into its region from the others; nothing else.
    heavy = {k: {r: dict(s) for r, s in racks.items()} for k, racks in tree.items()}
    heavy["region0"]["rack1"][2] = 3.0
    after = where(df, heavy)
    for i, old in before.items():
        new = after[i]
        if old == new:
            continue
        if old[0] != new[0]:
            assert new[0] == "region0"
        elif old[1] != new[1]:
            assert new[:2] == ("region0", "rack1")
        else:
            assert new == ("region0", "rack1", 2)


def test_slots_with_a_hot_id(spark):
    df = spark.range(0, 5000, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_slots(df).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
    assert len(rows) == 5000 and all(sorted(x) == list(range(len(x))) for x in shards.values())


def plain_divergence(docs, min_docs, top, smoothing=5):
    rows = [(r["lang"] or "", r["source"] or "", [t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", r["text"] or "")]) for r in docs.collect()]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = {s: Counter() for s in {r[1] for r in own}}
        for _, s, ts in own:
            counts[s].update(t for t in ts if t in kept)
        everything = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept)) for t in kept}
        q, by = p(everything), {s: p(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted(((-sum(abs(by[s][t] - by[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            terms = sorted((q[t] - by[s][t], t.encode(), t) for t in kept if counts[s][t] and by[s][t] > q[t])[:top]
            out |= {(lang, s, part, x, -v, i + 1) for part, own_rows in (("pair", pairs), ("term", terms)) for i, (v, _, x) in enumerate(own_rows)}
    return out


@pytest.mark.parametrize(("min_docs", "top", "block", "size"), [(3, 4, 128, 1 << 16), (1, 50, 1, 3), (2, 7, 2, 10), (500, 5, 128, 10)])
def test_divergence(docs, min_docs, top, block, size):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergence(docs, min_docs, top, block=block, slice_terms=size).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_divergence(docs, min_docs, top)


def test_divergence_small_blocks(docs, empty, monkeypatch):
    want = plain_divergence(docs, 2, 5)
    runs = [(r["lang"], r["term"], r["docs"], dict(zip(r["sources"], r["counts"], strict=True))) for r in divergence.kept_terms(docs.coalesce(1), 2).collect()]
    assert len({r[:2] for r in runs}) == len(runs)
    rows = divergence.divergence(docs.repartition(20), 2, 5).collect()
    assert {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows} == want
    assert divergence.divergence(empty).count() == 0


def test_divergence_scan_over_cut_batches():
    """Runs that batches cut anywhere, in a source too."""
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted((f"l{rng.randrange(2)}", f"t{rng.randrange(4)}", f"s{rng.randrange(3)}", i, rng.randrange(1, 4), rng.randrange(1, 9)) for i in range(200))
    schema = divergence._RUNS
    want = defaultdict(lambda: [0, Counter()])
    for lang, term, source, _, n, c in rows:
        want[lang, term][0] += n
        want[lang, term][1][source] += c
    for step in (1, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + step], strict=True), schema, strict=True)], schema=schema) for a in range(0, len(rows), step)]
        got = {(r["lang"], r["term"]): [r["docs"], Counter(dict(zip(r["sources"], r["counts"], strict=True)))] for b in divergence.scan_runs(30)(iter(batches)) for r in b.to_pylist()}
        assert got == {k: v for k, v in want.items() if v[0] >= 30}


def test_shares_are_exact():
    rng = random.Random(2)
    cases = [(c, t) for t in (1, 7, 10**6, 9 * 10**15) for c in {0, t, t // 3, *(rng.randrange(t + 1) for _ in range(50))}]
    got = divergence.share(np.array([c for c, _ in cases]), np.array([t for _, t in cases]))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in cases]


def plain_collocations(docs, least, top=2000, longest=5):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    f, n = defaultdict(Counter), Counter()
    for r in docs.collect():
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(r["text"] or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        c = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p in c for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and c[p] >= own[p[i:j]]}
        rows = []
        for p, a in c.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), (" ".join(p), a, own[p[:k]], own[p[k:]], n[lang], score)))
        out += [(lang, i + 1, *r[3]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "slots"), [(5, 2000, 1 << 21), (2, 9, 1 << 21), (5, 2000, 40), (100, 50, 1 << 21), (30_000, 5, 1 << 21)])
def test_collocations(docs, least, top, slots):
    rows = collocations.collocations(docs, least, top=top, most_slots=slots).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows) == plain_collocations(docs, least, top)


def test_collocations_in_small_arrays(docs, empty, monkeypatch):
    """Blocks, trees and filters of the smallest sizes change nothing."""
    want = plain_collocations(docs, 4)
    for name, value in (("BLOCK", 8), ("FAN_IN", 2), ("MOST_BITS", 64)):
        monkeypatch.setattr(collocations, name, value)
    rows = collocations.collocations(docs, 4).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows) == want
    assert collocations.collocations(empty).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(4)
    high, low = rng.integers(0, 1 << 62, 20_000, dtype=np.uint64), rng.integers(0, 1 << 62, 20_000, dtype=np.uint64)
    high[:50] = high[50]  # equal halves
    table = collocations.PerfectHash(high, low)
    assert sorted(table.slots(high, low).tolist()) == list(range(20_000))
    assert (table.slots(high, low ^ np.uint64(1)) == -1).all() and (table.slots(low, high) == -1).all()
    assert len(collocations.PerfectHash(high[:0], low[:0])) == 0
    assert (collocations.PerfectHash(high[:0], low[:0]).slots(high[:3], low[:3]) == -1).all()


def test_measure_is_exact():
    a = 10**12
    assert collocations.measure(a, 10**15, [(a, a + 1), (a + 1, a)]) == (1000 * a * 10**15 // (a * (a + 1)), a, a + 1)

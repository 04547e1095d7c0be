"""Each operator against a plain version, and on rows that are null, empty, very long, tied or repeated."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonearm.llm import chat, lm, media, mixing, neardups, packing, quality, queries, simhash, token_counts, topk, warc

LONG = "word " * 30_000
ODD = ["", None, "a", "ΑΣ ΟΔΟΣ Σ", "é ä 가", "a\x1cb\x85c\xa0d", "<|endoftext|>x <|startoftext|>", "x" * 5000, "don't I'LL 's", "\t\r\n", "Straße\nline two\n\nline", "same text", "same text", LONG]
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, uid long, slot int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(200)]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randrange(5, 300))) for _ in range(60)]
    texts += [t.replace("w1", "W1") for t in texts[20:30]]
    rows = [(i, t, "en", f"s{i % 3}", 1, 0.5, 7, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None, None, None, None, None)], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def texts_by_row(docs):
    return Counter((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())


def test_packing(docs, empty):
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, window=256, shard_tokens=4000).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    for (doc_id, text), times in texts_by_row(docs).items():
        ids = [*hf.encode(text, add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == times * len(ids) and {r["doc_tokens"] for r in own} == {len(ids)}
        if times == 1:
            assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == ids
    assert packing.pack(empty).count() == 0


def test_packing_long_runs():
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.byte_bpe()
    for text in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b"):
        assert encode(text).tolist() == hf.encode(text, add_special_tokens=False).ids


def test_packing_prefers_neighbours():
    a, b = np.arange(100, 140, dtype=np.uint32), np.arange(500, 540, dtype=np.uint32)
    p = packing.Packer(0, window=80)
    units = [a, b, a[::-1].copy(), b[::-1].copy(), np.arange(900, 940, dtype=np.uint32), np.arange(950, 990, dtype=np.uint32)]
    out = [x for i, u in enumerate(units) for x in p.add(i, u)] + list(p.finish())
    together = defaultdict(set)
    for doc, _, sequence, _, _ in out:
        together[sequence].add(doc)
    assert {0, 2} in together.values() and {1, 3} in together.values()


def test_token_counts(docs, empty):
    hf = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in token_counts.token_counts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        text = r["text"] or ""
        assert r["n_tokens"] == len(hf.encode(text, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 2048)
    assert token_counts.token_counts(docs).count() == docs.count() and token_counts.token_counts(empty).count() == 0


def test_token_counts_new_letters():
    path = public_tokenizers.path("word_bpe_49k.json")
    hf, own = Tokenizer.from_file(path), token_counts.MergeCounter(path)
    for text in ("\ua7cb", "x\ua7dcy \ua7cb", "\ua7cba" * 30, " " * 1_000_000):
        assert own.count(text) == len(hf.encode(text, add_special_tokens=False).ids)


def test_media(docs, empty):
    rows = media.media_digests(docs).collect()
    want = Counter()
    for (doc_id, text), times in texts_by_row(docs).items():
        p = media.padded(text.encode())
        want[(doc_id, len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += times
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert media.media_digests(empty).count() == 0


def test_media_reader(spark):
    payload = bytes(range(256)) * 9 * 20
    content = media.write_container(payload)
    (track,) = media.read_tracks(content)
    assert (track.codec, track.timescale, track.duration, track.width) == ("raw ", 25, len(payload) // 576, 24)
    for k in track.keys:
        at = track.offsets[k - 1]
        assert content[at : at + 576] == payload[(k - 1) * 576 : k * 576]
    assert media.samples(content, track) == payload
    rows = [(1, content), (2, None), (3, content[:-50]), (4, b""), (5, b"junk" * 9)]
    seen = {r["id"]: r for r in media.read_media(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert seen[1]["codec"] == "raw " and seen[1]["error"] is None
    assert all(seen[i]["error"] and seen[i]["codec"] is None for i in (2, 3, 4, 5))


def test_topk(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(600, 12)) * rng.exponential(size=(600, 1))
    m[50:90] = m[49]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000, None), (1001, [float("nan")] * 12), (1002, [0.0] * 12), (1003, [1.0]), (1004, [None] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(topk.top_k(df, df.where("vec_id % 20 = 0"), 10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids = np.array([*range(600), 1002])
    z = np.floor(1024 * np.vstack([m, np.zeros(12)])).astype(np.int64)
    for q in range(0, 600, 20):
        s = z @ z[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        assert got[q] == [(ids[i], s[i]) for i in order]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(none, none).count() == 0


def test_topk_large_components(spark):
    big = np.array([[2.0**40, -(2.0**40)], [2.0**62, 2.0**62]])
    assert topk.dots(big[:1], big[:1])[0, 0] == (1 << 63) - 1
    assert topk.dots(big[:1], big[1:])[0, 0] == 0
    rows = [(0, [1e301, 1.0]), (1, [-1e308, 0.5]), (2, [1.0, 2.0]), (3, [0.0, 0.0]), (4, [1e200, -1e200]), (5, [-3.0, 1e-9]), (6, [1.7e308, 1.7e308]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    z = {i: [int(c) * 1024 if abs(c) > 2**52 else math.floor(c * 1024) for c in v] for i, v in rows[:-1]}
    got = defaultdict(list)
    for r in sorted(topk.top_k(df, df, 4).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hold = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for q in z:
        want = sorted((-hold(sum(a * b for a, b in zip(z[q], z[i], strict=True))), i) for i in z if i != q)[:4]
        assert got[q] == [(i, -s) for s, i in want]


def test_topk_clashing_columns_and_repeated_ids(spark):
    rows = [(i % 7, [float(i), 1.0, -float(i % 3)], i, i, i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, norm int, dim int, uid int, part int")
    got = Counter((r["query_id"], r["rank"]) for r in topk.top_k(df, df.where("vec_id = 3"), 5).collect())
    assert got == {(3, rank): 6 for rank in range(1, 6)}


def chains(f, per_text, model):
    """Marginals by summing over all labellings."""
    out, at = [], 0
    e = model.emissions(quality.with_neighbours(f, per_text))
    for n in per_text:
        z, p = 0.0, np.zeros(n)
        for labels in np.ndindex(*[2] * n):
            w = math.exp(sum(e[at + i] * y for i, y in enumerate(labels)) + sum(model.transitions[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            z += w
            p += w * np.array(labels)
        out.append(p / z)
        at += n
    return out


def test_crf_marginals():
    texts = ["good line\nAAA!! ###\nok then", "x", "", "one\ntwo\nthree\nfour\nfive"]
    f, lengths, per_text = quality.line_features(texts)
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 + 3 * quality.OWN), rng.normal(size=(2, 2)), np.zeros(1 + 3 * quality.OWN), np.ones(1 + 3 * quality.OWN))
    want, at = [], 0
    for p in chains(f, per_text, model):
        w = lengths[at : at + len(p)]
        want.append((p * w).sum() / w.sum())
        at += len(p)
    assert np.allclose(model.score(texts), want)


def test_quality_learns(spark, docs, empty):
    rng = random.Random(1)
    words = ["the", "of", "water", "river", "light", "stone", "green", "walk"]
    good = [" ".join(rng.choices(words, k=40)) + ".\n" + " ".join(rng.choices(words, k=30)) for _ in range(150)]
    bad = [" ".join(w.upper() + "###" for w in rng.choices(words, k=40)) for _ in range(150)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(d, labels, sample=60).collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] < 150) for r in rows if r["held_out"])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    odd = quality.quality_scores(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.keep_good(docs, labels.where("false")).columns == docs.columns


def test_quality_repeated_ids(spark):
    lines = "\n".join(f"line {i}" for i in range(5000))
    d = spark.createDataFrame([(1, "good words here")] * 10_000 + [(2, "BAD!!! ###"), (2, "BAD ###")] * 50 + [(4, lines)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    sampled = quality.sampled(d, labels, sample=5).collect()
    assert sorted((r["doc_id"], r["quality"], r["lines"]) for r in sampled if r["doc_id"] != 4 or r["lines"] == quality.LINES) == sorted((r["doc_id"], r["quality"], r["lines"]) for r in sampled)
    assert len(sampled) == len({(r["doc_id"], r["quality"]) for r in sampled}) <= 4


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    want = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((d, f"{f:016x}") for d, f in want)
    fps = sorted({f for _, f in want})
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = defaultdict(list)
    for d, f in want:
        least[root[f]].append(math.inf if d is None else d)
    assert all((r["component_id"] if r["component_id"] is not None else math.inf) == min(least[root[int(r["fingerprint"], 16)]]) for r in rows)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [4096, 100])
def test_simhash_dense_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "CROWD", 16 if block == 4096 else 1)
    rng = np.random.default_rng(block)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(500)} | {int(x) for x in rng.integers(0, 1 << 63, 100)})
    nodes = spark.createDataFrame([(simhash.signed(f), simhash.signed(f)) for f in fps], "id long, fp long")
    got = defaultdict(set)
    for r in simhash.components(simhash.links(nodes, 4, block)).collect():
        got[r["root"]].add(r["node"])
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    want = defaultdict(set)
    for i, f in enumerate(fps):
        want[find(i)].add(simhash.signed(f))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_near_dedup(spark, docs, empty, tmp_path):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(30):
        base = rng.choices(words, k=200)
        for c in range(4):
            own = list(base)
            for _ in range(c):
                own[rng.randrange(200)] = rng.choice(words)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(own), "x"))
    spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, uid string").write.parquet(str(tmp_path / "d"))
    kept = neardups.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == ["doc_id", "text", "uid"]
    kept = [r["doc_id"] for r in kept.collect()]
    assert sorted(kept) == sorted({g: min(d for d, h in groups.items() if h == g) for g in range(30)}.values())
    docs.write.parquet(str(tmp_path / "odd"))
    odd = neardups.drop_near_duplicates(spark.read.parquet(str(tmp_path / "odd"))).collect()
    assert sum((r["text"] or "") == "" for r in odd) == 1 and sum(r["text"] == "same text" for r in odd) == 1
    assert neardups.drop_near_duplicates(empty).count() == 0


def test_near_dedup_holds_equal_rows_once(spark, tmp_path, monkeypatch):
    """Of rows equal in every column one goes on to be compared, however many there are."""
    rng = random.Random(3)
    text = " ".join(rng.choices([f"t{i}" for i in range(900)], k=300))
    near = " ".join([*text.split()[:-2], "other", "end"])
    reached = []
    verified = neardups.verified_links
    monkeypatch.setattr(neardups, "verified_links", lambda texts, *rest: (reached.append(texts.count()), verified(texts, *rest))[1])
    for times in (10, 4000):
        path = str(tmp_path / str(times))
        df = spark.range(times).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("s").alias("slot"))
        df.union(spark.createDataFrame([(7, near, "s"), (8, "alone", "s"), (8, "alone", "s")], df.schema)).repartition(3).write.parquet(path)
        kept = neardups.drop_near_duplicates(spark.read.parquet(path)).collect()
        assert sorted(r["doc_id"] for r in kept) == [5, 8]
    assert reached == [3, 3]


def test_pairs_that_share_enough_keys():
    """Prefixes of SHARED more hold so many common elements of any two similar sets, or all of small ones."""
    rng = random.Random(6)
    known = np.zeros(neardups.MAP_SLOTS // 2, np.uint8)
    for _ in range(400):
        n = rng.choice([1, 2, 3, 4, 5, 20, 80])
        a = {rng.randrange(1 << 62) for _ in range(n)}
        b = set(a)
        while b and len(a & b) / len(a | b) >= 0.8 and rng.random() < 0.8:
            b.add(rng.randrange(1 << 62)) if rng.random() < 0.5 else b.discard(rng.choice(sorted(b)))
        if not b or len(a & b) / len(a | b) < 0.8:
            continue
        keys, owner = neardups.prefix_keys([np.array(sorted(x), np.uint64) for x in (a, b)], 0.8, 4, known, neardups.SHARED)
        both = set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
        assert len(both) >= min(neardups.SHARED, len(a & b)) and (len(a & b) >= neardups.SHARED or min(len(a), len(b)) * 0.8 <= neardups.SHARED)


def test_near_dedup_whole(spark, tmp_path):
    """Appended, truncated and block-replaced copies, against every pair's similarity."""
    rng = random.Random(11)
    words = [f"t{i}" for i in range(3000)]
    texts = []
    for g in range(240):
        base = rng.choices(words, k=rng.randrange(8, 400))
        n = max(1, int(len(base) * rng.uniform(0.02, 0.2)))
        at, other = rng.randrange(len(base)), rng.choices(words, k=n)
        texts += [" ".join(x) for x in (base, (base + other, base[:-n], base[:at] + other[: n // 2 + 1] + base[at + n // 2 + 1 :])[g % 3])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    sets = [set(zip(*[x.split()[k:] for k in range(5)], strict=False)) for x in texts]
    near = [i for i in range(1, len(texts), 2) if len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1])]
    assert 60 < len(near) < 235
    kept = {r["doc_id"] for r in neardups.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert kept == set(range(len(texts))) - set(near)


def test_near_dedup_of_chained_texts(spark, tmp_path, monkeypatch):
    """Texts that share passages with their neighbours alone are no group to be verified as a whole; near copies among them are."""
    rng = random.Random(13)
    words = [f"t{i}" for i in range(3000)]
    parts = [rng.choices(words, k=30) for _ in range(301)]
    changed = lambda x, at: " ".join([*x[:at], "new", *x[at + 1 :]])
    texts = [" ".join(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    texts += [changed(texts[i].split(), rng.randrange(60)) for i in range(0, 300, 10)]
    base = rng.choices(words, k=200)
    texts += [changed(base, 5 * i) for i in range(40)]  # more than are tied in pairs
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    sets = [set(zip(*[x.split()[k:] for k in range(5)], strict=False)) for x in texts]
    near = [i for i in range(1, len(texts)) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(i))]
    assert len(near) > 60
    verified, seen = neardups.verified_links, []
    monkeypatch.setattr(neardups, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(neardups, "verified_links", lambda texts, groups, *a: seen.append(groups.groupBy("root").count().collect()) or verified(texts, groups, *a))
    kept = {r["doc_id"] for r in neardups.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert kept == set(range(len(texts))) - set(near)
    assert max(r["count"] for r in seen[0]) == 40


def test_sketches():
    """Sketches never differ in more bits than the sets do in hashes, and tell most other sets apart."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 40, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (0, 1, n // 20, n // 5, n):
            y = np.unique(np.concatenate([x[m:], rng.integers(0, 1 << 63, 2 * m).astype(np.uint64)]))
            differ = len(x) + len(y) - 2 * len(np.intersect1d(x, y))
            assert neardups.apart(neardups.sketch(x), neardups.sketch(y)) <= differ
            assert neardups.apart(neardups.sketch(x), neardups.sketch(x)) == 0
        y = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert n < 40 or neardups.apart(neardups.sketch(x), neardups.sketch(y)) > 2 * n / 9


def test_collapse(spark):
    logs = {1: "ab", 2: "abc", 3: "abcd", 4: "xy", 5: "xy", 6: "b", 7: "abx", 8: "x"}
    rows = [(c, i, "user" if i % 2 else "system", t) for c, ts in logs.items() for i, t in enumerate(ts)] + [(None, 0, "user", "a"), (9, 0, None, None), (9, 0, None, None), (10, None, None, None)]
    out = {r["conv_id"]: r for r in chat.collapse_snapshots(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {3, 4, 6, 7, 9} and out[4]["n_copies"] == 2 and out[9]["n_turns"] == 2
    assert out[6]["rendered"] == "<|im_start|>system\nb<|im_end|>\n"
    assert chat.collapse_snapshots(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mixing_margins(spark, docs, empty):
    cells = spark.createDataFrame([(s, l, t, 10 * (i + 1)) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xy" for t in "pqr")], "source string, lang string, topic string, tokens long")
    powers = {"source": 0.0, "lang": 0.5, "topic": 1.0}
    made = mixing.calibrated_cells(cells, {"topic": {"p": 0.7, "absent": 0.1}}, powers).toPandas()
    assert np.allclose(made.groupby("source")["weight"].sum(), 0.5)
    base = made.groupby("lang")["base"].sum() ** 0.5
    assert np.allclose(made.groupby("lang")["weight"].sum(), base / base.sum())
    own, got = made.groupby("topic")["base"].sum(), made.groupby("topic")["weight"].sum()
    rest = 0.2 * own[["q", "r"]] / own[["q", "r"]].sum()
    assert np.allclose(got[["p", "q", "r"]], np.array([0.7, *rest]) / 0.9)
    assert mixing.mixed(docs, keep=1e9).count() > 0 and mixing.mixture_report(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_sampled_shares(spark):
    """A source of 0.3 % of the tokens, whose weight is many times its own, and a language with a target of its own."""
    sizes = {"a": 6600, "b": 13340, "c": 60}
    rows = [(f"{s}{i}", "five words are in this", ("en", "de")[i % 2], s) for s, n in sizes.items() for i in range(n)]
    kept = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, "doc_id string, text string, lang string, source string"), "").groupBy("source", "lang").count().toPandas()
    power = {s: (n / 20_000) ** mixing.POWERS["source"] for s, n in sizes.items()}
    for s in sizes:
        assert abs(kept[kept["source"] == s]["count"].sum() / kept["count"].sum() / (power[s] / sum(power.values())) - 1) < 0.1
    assert abs(kept[kept["lang"] == "en"]["count"].sum() / kept["count"].sum() - mixing.TARGETS["lang"]["en"]) < 0.03


def test_topk_of_wide_vectors(spark):
    """A part holds a bounded number of bytes, so wide vectors lie in more of them."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3000).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before, topk.PART_BYTES = topk.PART_BYTES, 1 << 20
    try:
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 3).collect()}
    finally:
        topk.PART_BYTES = before
    v = np.floor(1024 * np.array([x for _, x in rows])).astype(np.int64)
    for q in range(0, 400, 100):
        scores = sorted(((-int(v[q] @ v[i]), i) for i in range(400) if i != q))[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in scores]


def test_warc(spark):
    rows = [(1, "http://a/b c", "x"), (2, None, "x"), (3, "u", ""), (4, "u", None), (5, "é\r\nq", "y" * 100_000), (7, "u", "solo"), (7, "u", "solo"), (None, "u", "no id"), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.warc_round_trip(pages).collect())
    want, best = Counter(), {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    for p, _, h in rows:
        h, again = h or "", p is not None and best[h or ""] != p
        want[(p, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", best[h] if again else None)] += 1
    assert got == want
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_gap_like_the_planted_one(spark):
    """A gap as long as the planted record, elsewhere or for another reason, fails the reader, and so does a page that is missing."""
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    noise = warc.damaged_record()
    (r,) = warc.write_archives(pages, noise=noise).collect()
    data, second = bytes(r["content"]), r["second"]
    assert r["records"] == 5 and data[second : second + len(noise)] == noise
    read = lambda content: warc.read_archives(spark.createDataFrame([("a", bytearray(content), 5, second)], "archive string, content binary, records long, second long"), len(noise)).where("gap IS NULL").count()
    assert read(data) == 5
    rest = data[second + len(noise) :]
    for bad in (data[:second] + b"x" * len(noise) + rest, data + b"y" * len(noise), data[:second] + rest + noise, data[:second] + noise):
        with pytest.raises(Exception, match="records, gaps"):
            read(bad)


def test_warc_salvage():
    parts = [warc.member(warc.record(i, "u", b"page %d " % i * 50)) for i in range(6)]
    plain = warc.record(9, "u", b"bare")
    broken = bytearray(parts[2])
    broken[40] ^= 0xFF
    data = parts[0] + b"noise" + parts[1] + bytes(broken) + plain + parts[3][:-9] + parts[4]
    seen = list(warc.read_archive(data))
    ids = [x.headers[b"warc-record-id"] for x in seen if isinstance(x, warc.Record)]
    assert ids == [warc.urn(i) for i in (0, 1, 9, 3, 4)]  # 3 lies whole in its cut member
    gaps = [(x.at, x.end) for x in seen if isinstance(x, warc.Gap)]
    at = len(parts[0])
    assert gaps[0] == (at, at + 5) and len(gaps) == 3
    covered = sorted((x.at, x.end) for x in seen if isinstance(x, warc.Gap) or x.headers[b"warc-record-id"] != warc.urn(3))
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_warc_members_of_several_records():
    parts = [warc.record(i, "u", b"page %d " % i * 500) for i in range(5)]
    whole = warc.member(b"".join(parts))
    ids = lambda data: [int(x.headers[b"warc-record-id"][10:-1]) for x in warc.read_archive(data) if isinstance(x, warc.Record)]
    assert ids(whole) == [0, 1, 2, 3, 4] and len(list(warc.read_archive(whole))) == 5
    altered = warc.member(b"".join(parts[:2] + [warc.damaged_record()] + parts[2:]))
    seen = list(warc.read_archive(altered))
    assert ids(altered) == [0, 1, 2, 3, 4] and [x.reason for x in seen if isinstance(x, warc.Gap)] == ["block digest"]
    cut = whole[:-40] + warc.member(warc.record(7, "u", b"next"))
    assert ids(cut)[-1] == 7 and ids(cut)[:3] == [0, 1, 2] and sum(isinstance(x, warc.Gap) for x in warc.read_archive(cut)) == 1
    assert ids(warc.member(b"") + whole) == [0, 1, 2, 3, 4]


def test_warc_reader_takes_linear_time():
    part = warc.member(warc.record(1, "u", b"short"))

    def seconds(n):
        began = time.process_time()
        assert sum(isinstance(x, warc.Record) for x in warc.read_archive(part * n)) == n
        return time.process_time() - began

    seconds(100)
    assert seconds(20_000) < 12 * seconds(4_000)


def slow_ctw(lines, depth):
    """The context tree by recursion over its nodes."""
    counts = defaultdict(lambda: [0, 0])
    for line in lines:
        data = bytes(depth) + line
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for k in range(8):
                    counts[(data[i - d : i], 1 << k | data[i] >> (8 - k))][data[i] >> (7 - k) & 1] += 1

    def weighted(c, node):
        own = math.lgamma(counts[c, node][0] + 0.5) + math.lgamma(counts[c, node][1] + 0.5) - math.log(math.pi) - math.lgamma(sum(counts[c, node]) + 1)
        if len(c) == depth:
            return own, own, None
        below = sum(weighted(bytes([x]) + c, node)[0] for x in range(256) if (bytes([x]) + c, node) in counts)
        return np.logaddexp(own, below) - math.log(2), own, below

    def one(context, node):
        c, p, left = b"", 0.0, 1.0
        if (c, node) not in counts:
            return 0.5
        while True:
            a, b = counts[c, node]
            kt = (b + 0.5) / (a + b + 1)
            longer = context[len(context) - len(c) - 1 :] if len(c) < depth else None
            if longer is None or (longer, node) not in counts:
                return p + left * kt
            _, own, below = weighted(c, node)
            stay = math.exp(own - np.logaddexp(own, below))
            p, left, c = p + left * stay * kt, left * (1 - stay), longer

    def score(line):
        data, out = bytes(depth) + line, 0.0
        for i in range(depth, len(data)):
            for k in range(8):
                p = one(data[i - depth : i], 1 << k | data[i] >> (8 - k))
                out += math.log2(p if data[i] >> (7 - k) & 1 else 1 - p)
        return out

    return score


@pytest.mark.parametrize("depth, crowd", [(2, 256), (4, 1), (4, 12), (4, 10**6), (3, 256), (5, 100)])
def test_context_tree(spark, depth, crowd):
    """With no context crowded, with some and with every one: dealt by two bytes or by three."""
    train, test = ["the cat sat", "the hat", "a cat", "hat hat hat hat"], ["the cat", "zebra hat", ""]
    rows = [(x, True) for x in train] + [(x, False) for x in test]
    table = {r["gram"]: (r["n"], r["log2p"]) for r in lm.gram_table(spark.createDataFrame(rows, "text string, train boolean"), depth, crowd).collect()}
    lines = {x: x.encode() + b"\n" for x in train + test}
    seen, _ = lm.coded([lines[x] for x in train], depth)
    assert {g: n for g, (n, _) in table.items() if n} == dict(Counter(seen.view(np.int64).tolist()))
    slow = slow_ctw([lines[x] for x in train], depth)
    for line in lines.values():
        own, _ = lm.coded([line], depth)
        assert math.isclose(sum(table[g][1] for g in own.view(np.int64).tolist()), slow(line), rel_tol=1e-9)


def test_context_tree_large_counts():
    grams, _ = lm.coded([b"aaaaaaaa\n"], 5)
    grams = np.unique(grams)
    n = np.full(len(grams), 1e9)
    tree = lm.Subtrees(grams, n, 5)
    counts, below = np.zeros(65536), np.zeros(65536)
    np.add.at(counts, (grams & np.uint64(0xFFFF)).astype(int), n)
    key, x = tree.above()
    below[key.astype(int)] = x
    other, _ = lm.coded([b"aaaaab\n", b"zz\n"], 5)
    p = tree.log2(other, lm.Top(counts, below))
    assert np.isfinite(p).all() and p.min() > -400


def test_lm_rare_grams_meet_in_a_join(docs):
    few = {r["doc_id"]: r for r in lm.lm_scores(docs, common_grams=30).collect()}
    for r in lm.lm_scores(docs).collect():
        assert math.isclose(r["score"], few[r["doc_id"]]["score"], rel_tol=1e-6) and (r["n_known"], r["n_tokens"]) == (few[r["doc_id"]]["n_known"], few[r["doc_id"]]["n_tokens"])


def test_lm_scores(docs, empty):
    rows = lm.lm_scores(docs, depth=3, common_words=20).collect()
    split = lambda t: (t or "").encode().lower().split()
    known, ends = Counter(), 0
    own = docs.select("doc_id", "text").collect()
    for d, t in own:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2:
            known.update(split(t))
            ends += 1
    total, kinds = sum(known.values()) + ends, len(known) + 1
    want = defaultdict(list)
    for d, t in own:
        w = split(t)
        base = sum(math.log10((known[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1))
        want[d].append((len(w) + 1, 1 + sum(known[x] > 0 for x in w), base))
    for r in rows:
        n, k, base = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, k, total) and math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert len(rows) == len(own) and lm.lm_scores(empty).count() == 0


def test_oracles_are_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [int(n[2 : n.index("_")]) for n in queries.QUERIES] == list(range(1, 14))


def test_clashing_columns(spark):
    """Columns of the operators' own names, beside what they read."""
    turns = spark.createDataFrame([(1, 0, "user", "a", 9, 9, 9, 9), (2, 0, "user", "a", 8, 8, 8, 8), (2, 1, "system", "b", 8, 8, 8, 8)], "conv_id long, turn long, role string, text string, place int, h1 int, h2 int, turns int")
    assert [(r["conv_id"], r["n_turns"], r["n_copies"]) for r in chat.collapse_snapshots(turns).collect()] == [(2, 2, 1)]
    pages = spark.createDataFrame([(1, "u", "x", 1, 2, 3, 4), (2, "u", "x", 1, 2, 3, 4)], "page_id long, url string, html string, digest int, target int, copies int, archive int")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect()) == [(1, "revisit", 2), (2, "response", None)]
    docs = spark.createDataFrame([(1, "one two three four five six", 5, 6, 7, "q"), (2, "one two three four five six", 5, 6, 7, "q")], "doc_id long, text string, fp int, node int, digest int, rest string")
    assert [r["component_id"] for r in simhash.near_duplicates(docs).collect()] == [1, 1]
    kept = neardups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "one two three four five six", 5, 6, 7, "q")]
    read = media.read_media(media.store_media(docs).withColumn("codec", F.lit("mine")))
    assert {r["codec"] for r in read.collect()} != {"mine"}


def test_very_long_runs(spark):
    """A million equal characters, spaces or line ends in one text."""
    rows = [(1, "x" * 1_000_000), (2, " " * 1_000_000), (3, "\n" * 1_000_000), (4, "ab " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_bytes"] for r in token_counts.token_counts(docs).collect()} == {d: len(t) for d, t in rows}
    assert sum(r["length"] for r in packing.pack(docs).select("doc_id", "length").collect() if r["doc_id"] == 2) > 1
    assert len(simhash.near_duplicates(docs).collect()) == 4 and len(media.media_digests(docs).collect()) == 4
    assert {r["doc_id"] for r in neardups.drop_near_duplicates(docs).select("doc_id").collect()} == {1, 2, 3, 4}
    scores = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, depth=3).collect()}
    assert all(math.isfinite(x) for x in scores.values()) and len(scores) == 4
    model = quality.untrained()
    assert model.score(["\n" * 20_000, "x" * 1_000_000]).tolist() == [0.5, 0.5]

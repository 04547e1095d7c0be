import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tonearm.llm import mixing, neardups, quality

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, uid long, slot int, digest string, row string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Of each near-duplicate component, over all pairs, the smallest id (null last)."""
    texts = sorted({t or "" for _, t in rows})
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    at = {t: i for i, t in enumerate(texts)}
    for d, t in rows:
        least[find(at[t or ""])].append((d is None, d))
    return Counter(min(x)[1] for x in least.values())


def check_pieces(rows, docs):
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, np.array(hf.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t in docs)
    got, open_, sequences = Counter(), defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        open_[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    for (d, n), parts in open_.items():
        by_start = defaultdict(list)
        for start, ids in parts:
            by_start[start].append(ids)
        for _ in range(len(by_start[0])):
            whole = b""
            while len(whole) < 4 * n:
                # Of repeated ids any piece that fits a wanted text goes on.
                fits = [x for x in by_start[len(whole) // 4] if any(k[0] == d and k[1].startswith(whole + x) for k in want)]
                by_start[len(whole) // 4].remove(fits[0])
                whole += fits[0]
            got[d, whole] += 1
    assert got == want
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == list(np.cumsum([0, *[n for _, n in parts[:-1]]])) and sum(n for _, n in parts) <= 1024


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "mix_sources", "pack_sequences"]


def test_stages_against_plain_versions(spark):
    """Each stage on what the one before kept, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    (_, keep), (_, dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

    kept = keep(spark, docs, SF).cache()
    own = pairs(docs)
    good = model.score([t or "" for _, t in own]) >= 0.5
    assert kept.columns == columns and Counter(pairs(kept)) == Counter(x for x, g in zip(own, good, strict=True) if g)
    rejected = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len({d for d, _ in pairs(kept)} & rejected) <= 0.1 * len(rejected)

    single = dedup(spark, kept, SF).cache()
    assert single.columns == columns and Counter(d for d, _ in pairs(single)) == survivors(pairs(kept)) and single.count() < kept.count()

    sample = mix(spark, single, SF).cache()
    duck = duckdb.connect()
    duck.register("documents", single.toArrow())
    want = [r[0] for r in duck.execute(f"SELECT doc_id FROM ({mixing.report_sql()})").fetchall()]
    assert sample.columns == columns and Counter(d for d, _ in pairs(sample)) == Counter(want) and want

    check_pieces(pack(spark, sample, SF).collect(), pairs(sample))


@pytest.fixture(scope="module")
def odd(spark):
    long = "word " * 40_000
    texts = ["", None, "a", "one two three four five six", "one two three four five six", "One two three four five six", long, " " * 200_000, "\t\n", "Straße\nline", "x" * 5000] + [f"t{i} " * 3 + " ".join(f"w{i * k % 97}" for k in range(60)) for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", 1, 0.5, 7, 1, 2, "d", "r") for i, t in enumerate(texts)]
    nulls = (None,) * 9
    return spark.createDataFrame([*rows, rows[3], rows[3], rows[20], (None, texts[21], *nulls), (None, "no id", *nulls), (None, "no id", *nulls), (None, None, *nulls)], COLUMNS)


def test_odd_rows_through_all_stages(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}


def test_no_rows(spark, odd, tmp_path):
    odd.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_of_odd_rows_in_any_partitioning(spark, odd):
    want = survivors([(r["doc_id"], r["text"]) for r in odd.collect()])
    for parts in (1, 3, 17):
        assert Counter(r["doc_id"] for r in neardups.drop_near_duplicates(odd.repartition(parts)).collect()) == want

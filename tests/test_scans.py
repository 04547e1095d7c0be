"""Scans and rate conversion along streams that lie in many buckets, against plain windows and the whole stream at once."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonearm.operators import redirects, seeks, streams
from tonearm.operators import resampling as R
from tonearm.operators.scans import scan


def test_scan_equals_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2]), rng.randrange(50), i, rng.choice([None, *range(9)])) for i in range(600)]
    df = spark.createDataFrame([*rows, (9, 1, 1000, None)], "k long, at long, id long, v long").repartition(5)
    w = Window.partitionBy("k").orderBy("at", "id")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.sum("v").over(so_far).alias("s"), F.last("v", True).over(so_far).alias("l"), F.lag("v").over(w).alias("b"), F.max("v").over(before).alias("m"))
    for buckets in (1, 2, 13, 40):
        v = F.col("v")
        got = scan(df, ["k"], ["at", "id"], sums={"s": v}, lasts={"l": v}, befores={"b": v}, maxima={"m": v}, buckets=buckets)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert scan(df.limit(0), ["k"], ["at", "id"], sums={"s": F.col("v")}).count() == 0


def test_scan_of_one_stream_uses_many_tasks(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = scan(df, [], ["id"], sums={"s": F.col("v")}, buckets=25)
    assert {r["id"]: r["s"] for r in got.collect()} == {i: int(s) for i, s in enumerate(np.cumsum(np.arange(5000) % 7))}
    parts = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def direct(x, source, target):
    """Each output by the formula of the filter, without a table of phases."""
    n = -(-len(x) * target // source)
    cut, out = R.cutoff() * min(1, target / source), np.zeros((n, x.shape[1]))
    h = R.table(cut)
    for k in range(n):
        frame, rest = divmod(k * source, target)
        s = rest / target * 256
        for j in range(max(0, frame - 70), min(len(x), frame + 70)):
            e = (R.HALO + 2 + frame - j) * 256 + int(s)
            if 0 <= e < len(h) - 2:
                y0, y1, y2 = h[e : e + 3]
                f = s - int(s)
                out[k] += x[j] * (y0 + (-3 * y0 + 4 * y1 - y2) / 2 * f + (y0 - 2 * y1 + y2) / 2 * f * f)
    return out


@pytest.mark.parametrize(("source", "target"), [(44_100, 48_000), (48_000, 44_100), (8_000, 48_000), (96_000, 48_000), (44_101, 48_000)])
def test_whole_stream_is_the_formula(source, target):
    x = np.random.default_rng(3).normal(size=(300, 2))
    y = R.resample(x, source, target)
    assert len(y) == -(-300 * target // source) and np.abs(y - direct(x, source, target)).max() < 1e-9


def test_filter():
    # The table's gain is one at every phase; at the band's end the filter is down, and at the cutoff's half it passes.
    assert np.abs(R.phases(44_100, 48_000).sum(1) - 1).max() < 1e-5
    h, n = R.table(R.cutoff()), np.arange(len(R.table(R.cutoff())))
    gain = lambda f: abs((h * np.exp(-1j * np.pi * f * n / R.OVERSAMPLING)).sum()) / R.OVERSAMPLING  # noqa: E731  f as a share of the band
    assert gain(0.5) == pytest.approx(1, abs=1e-5) and gain(1.0) < 1e-4 and 0.9 < R.cutoff() < 0.95
    t = np.arange(4410) / 44_100
    y = R.resample(np.sin(2 * np.pi * 440 * t), 44_100, 48_000)
    assert len(y) == 4800 and np.abs(y - np.sin(2 * np.pi * 440 * np.arange(4800) / 48_000))[100:-100].max() < 1e-4
    assert np.abs(R.resample(np.sin(2 * np.pi * 20_000 * t), 44_100, 22_050)[100:-100]).max() < 1e-4
    assert len(R.resample(np.ones(5), 44_100, 48_000)) == 6 and len(R.resample(np.zeros(0), 44_100, 48_000)) == 0
    assert R.resample(np.ones(5), 48_000, 48_000).tolist() == [1.0] * 5


@pytest.mark.parametrize("channels", [1, 2])
def test_chunks_are_as_the_joined_stream(spark, channels):
    rng = np.random.default_rng(7)
    rows, whole = [], {}
    for k, sizes in {"ones": [1] * 90, "small": [0, 1, 2, 63, 64, 65, 1, 300], "large": [10_000, 1, 700], "empty": [0]}.items():
        x = rng.normal(size=(sum(sizes), channels))
        whole[k], at = x, 0
        for i, n in enumerate(sizes):
            rows.append((k, i, 44_100, x[at : at + n].ravel().tolist()))
            at += n
    rows += [("small", 100, 44_100, None), ("same", 0, 48_000, [0.5] * 6), ("same", 1, 48_000, [0.25] * 2)]
    df = spark.createDataFrame(rows, "k string, i long, sample_rate int, samples array<double>").repartition(5)
    for block in (100, 4096):
        got = R.resampled(df, ["k"], ["i"], 48_000, channels, block=block, buckets=6).collect()
        for k, x in whole.items():
            own = sorted((r["position"], r["samples"]) for r in got if r["k"] == k)
            want, at = R.resample(x, 44_100, 48_000).reshape(-1, channels), 0
            for position, y in own:
                assert position == at
                assert np.abs(np.reshape(y, (-1, channels)) - want[at : at + len(y) // channels]).max() < 1e-12
                at += len(y) // channels
            assert at == len(want) == -(-len(x) * 48_000 // 44_100)
        assert [r["samples"] for r in got if r["k"] == "same"] == [[0.5] * 6 + [0.25] * 2]


def test_a_stream_that_changes_its_rate_ends(spark):
    rows = [("a", 0, 44_100, [0.1] * 8), ("a", 1, 48_000, [0.1] * 8), ("a", 2, 44_100, [0.1] * 8), ("b", 0, 44_100, [0.1] * 4), ("b", 1, 44_100, [0.1] * 3), ("b", 2, 44_100, [0.1] * 4), ("c", 0, 8_000, None), ("c", 1, 44_100, [0.1] * 2)]
    df = spark.createDataFrame(rows, "k string, i long, sample_rate int, samples array<double>")
    got = R.resampled(df, ["k"], ["i"], 48_000, 2, buckets=3).collect()
    assert sorted(str((r["k"], r["error"], r["samples"] and len(r["samples"]))) for r in got) == [
        "('a', 'RESAMPLE_ERROR', None)", "('a', None, 10)", "('b', 'RESAMPLE_ERROR', None)", "('b', None, 6)", "('c', None, 4)"
    ]


def test_count_windows_of_one_stream(spark):
    rows = [(1, i, [float(i)] * (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, x array<double>")
    plain, long = (sorted(map(tuple, streams.count_windows(df, "k", ["i"], "x", 7, **how).collect())) for how in ({}, {"long": True, "buckets": 9}))
    assert plain == long and len(plain) == -(-300 // 7)


def test_seeks(spark):
    rng = random.Random(9)
    rows, whole = [], {"a": [], "b": [], "none": []}
    for k in ("a", "b"):
        for i in range(60):
            x = [float(len(whole[k]) + j) for j in range(rng.choice([0, 2, 4, 50, 400]))]
            whole[k] += x
            rows.append((k, i, 1000, x))
    rows += [("a", 100, 1000, None)]
    chunks = seeks.placed(spark.createDataFrame(rows, "k string, i long, sample_rate int, samples array<double>").repartition(4), "k", ["i"], 2, buckets=5)
    asked = [(n, rng.choice(["a", "b", "none"]), rng.choice([0, 1, 50, 2000, 10**6, rng.randrange(4000)]), rng.choice([0, 1, 7, 3000])) for n in range(200)]
    for width in (16, 1 << 14):
        got = seeks.seek(spark.createDataFrame(asked, "id long, k string, at_ms long, n_frames long"), chunks, "k", channels=2, width=width).collect()
        assert len(got) == len(asked)
        for r in got:
            _, k, at, n = asked[r["id"]]
            assert r["samples"] == whole[k][2 * at : 2 * (at + n)] and r["n_frames"] == len(r["samples"]) // 2
    plan = seeks.seek(spark.createDataFrame(asked, "id long, k string, at_ms long, n_frames long"), chunks, "k")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_redirects(spark):
    at = lambda i: f"https://h{i}.example/a/b"
    hops = [(at(i), f"//h{i + 1}.example/a/b") for i in range(12)] + [("https://x.example/a", "../c?d"), ("https://loop.example/", "https://loop.example/"), ("https://p.example/", "http://p.example/"), ("https://n.example/", None), ("https://x.example/a", "z")]
    asked = [(1, at(3), True), (2, at(2), True), (3, at(12), False), (4, "https://x.example/a", True), (5, "https://loop.example/", False), (6, "https://p.example/", True), (7, "https://p.example/", None), (8, "https://n.example/", True), (9, "https://10.0.0.1/", True), (10, None, False), (11, at(3), True)]
    got = redirects.followed(spark.createDataFrame(asked, "id long, url string, public_only boolean"), spark.createDataFrame(hops, "url string, location string")).collect()
    assert {r["id"]: (r["url"], r["hops"], r["error"]) for r in got} == {
        1: (at(12), 9, None), 2: (None, 9, "INVALID_SOURCE"), 3: (at(12), 0, None), 4: ("https://x.example/c?d", 1, None), 5: (None, 9, "INVALID_SOURCE"), 6: (None, 0, "INVALID_SOURCE"),
        7: ("http://p.example/", 1, None), 8: ("https://n.example/", 0, None), 9: (None, 0, "INVALID_SOURCE"), 10: (None, 0, "INVALID_SOURCE"), 11: (at(12), 9, None),
    }

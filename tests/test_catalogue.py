import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.functions import arrays as A
from tonearm.functions import numbers as N
from tonearm.functions import rules as R
from tonearm.operators import streams as S
from tonearm.plans import catalogue, column_rules, delivery, live, media, sessions, validation  # noqa: F401
from tonearm.sources import containers, tables
from tonearm.streaming import folds

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, int | float | np.number) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    if name not in catalogue.ORACLE_SQL:
        assert got.num_rows
        return
    want = duck.execute(catalogue.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted(repr([plain(r[c]) for c in sorted(t.column_names)]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_numbers(spark):
    d = lambda x: F.lit(float(x))
    r = one(spark, N.dbfs(d(0)), N.dbfs(d("nan")), N.clamp(d("nan"), -1.0, 1.0), N.saturating_add(F.lit(N.I64), F.lit(1)), N.wrap(F.lit(4294967295) + 960), N.soft_limit(d(0.5)), N.soft_limit(d(-3)))
    assert r[0] == r[1] == -120 and r[2] != r[2] and r[3] == N.I64 and r[4] == 959 and r[5] == 0.5 and -1 <= r[6] < -0.95
    g = one(spark, N.replay_gain(F.lit(-7.5), F.lit(None).cast("double"), F.lit(0.5), F.lit(None).cast("double"), preamp=2.0), N.replay_gain(F.lit(6.0), F.lit(None).cast("double"), F.lit(0.9), F.lit(None).cast("double"), target_peak=-1.0))
    assert g[0]["gain_db"] == -5.5 and not g[0]["clipping_limited"] and abs(g[1]["gain_db"] + 0.08) < 1e-9 and g[1]["clipping_limited"]


def test_arrays(spark):
    s = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(spark, A.mono_to_stereo(s(0.25, -0.5)), A.downmix(s(0.2, 0.4, 0.6, 0.8), 4), A.downmix(s(1.0, 2.0, 3.0), 2), A.pad_to(s(0.5), 3), A.resampled_length(F.lit(4410), 44_100, 48_000), A.apply_volume(s(1.25, -1.5), 1.0), A.trim(s(1, 2, 3, 4, 5, 6), 2, F.lit(1), F.lit(1)))
    assert r[0] == [0.25, 0.25, -0.5, -0.5] and np.allclose(r[1], [0.55, 0.75]) and r[2] is None and r[3] == [0.5, 0, 0] and r[4] == 4800 and r[5] == [1, -1] and r[6] == [3, 4]


def test_rules(spark):
    urls = ["https://1.1.1.1/live", "http://a.b/", "https://127.0.0.1/", "https://10.0.0.1/", "https://169.254.169.254/", "https://[::1]/", "https://a.b:8443/"]
    assert [x is None for x in one(spark, *[R.url_policy(F.lit(u), True) for u in urls])] == [True] + [False] * 6
    r = one(spark, R.is_hls(F.lit("a/INDEX.M3U8?x"), F.lit("mp3")), R.hls_response(F.lit("/x"), F.lit("application/vnd.apple.mpegurl; charset=utf-8")), R.channel_rank(F.lit("6")), R.channel_rank(F.lit("2/JOC")), R.channel_rank(F.lit(None).cast("string")), R.codec_class(F.lit("avc1.4D401E, mp4a.40.2")), R.elementary_kind(F.unhex(F.lit("FFF1"))), R.elementary_kind(F.unhex(F.lit("FFFB"))))
    assert list(r) == [True, True, 1, 0, 1, "verified", "aac", "mpeg"]
    h = lambda **kw: F.create_map(*[F.lit(x) for k, v in kw.items() for x in (k.replace("_", "-"), v)])
    assert list(one(spark, R.live_response(h(icy_name="x")), R.live_response(h(Server="Icecast 2", content_type="audio/mpeg")), R.live_response(h(server="Icecast", content_type="text/html")), R.headers(F.lit("url"), h(referer="x"), F.lit(False)), R.headers(F.lit("url"), h(Host="x"), F.lit(False)))) == [True, True, False, None, "INVALID_SOURCE"]


def test_wav(spark):
    x = np.arange(-100, 100, dtype="<i2") * 100
    data = b"RIFF" + struct.pack("<I", 36 + x.nbytes) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 48_000, 192_000, 4, 16) + b"data" + struct.pack("<I", x.nbytes) + x.tobytes()
    row = containers.decode(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).first()
    assert (row["sample_rate"], row["channels"]) == (48_000, 2) and np.allclose(row["samples"], x / 32768)
    with pytest.raises(containers.NoDecoder):
        containers.read_audio(spark, "/nowhere", "mp3")


def test_boxes():
    box = lambda k, n=0: struct.pack(">I4s", 8 + n, k) + bytes(n)
    assert containers.fragment_ok(box(b"ftyp") + box(b"moov"), True) and containers.fragment_ok(box(b"styp") + box(b"moof") + box(b"mdat"), False)
    assert not containers.fragment_ok(box(b"mdat") + box(b"moof"), False)
    whole = box(b"ftyp", 8) + box(b"moov", 40)
    assert [containers.fast_start(x) for x in (whole[:30], whole, box(b"ftyp") + box(b"mdat", 4), box(b"moov"))] == ["pending", "progressive", "artifact", "artifact"]
    ts = lambda cc, start, body: bytes([0x47, 0x40 * start | 1, 0, 0x10 | cc]) + body.ljust(184, b"\xff")
    pes = b"\0\0\1\xc0\0\0\x80\0\0"
    assert containers.transport_audio(ts(3, 1, pes + b"a") + ts(4, 0, b"b"))[:1] == b"a"
    with pytest.raises(ValueError):
        containers.transport_audio(ts(3, 1, pes) + ts(5, 0, b""))


def test_playout():
    s, out = folds.playout_start(prebuffer_ms=40, max_late_ms=100), []
    for at in (0, 20, 40, 60, 400, 420, 440):
        s, made = folds.playout_step(s, {"at_ms": at})
        out += made
    kinds = [x["kind"] for x in out]
    assert kinds[0] == "prebuffer_ready" and "underrun" in kinds and kinds.count("prebuffer_ready") == 1
    sent = [x for x in out if x["kind"] == "sent"]
    assert [x["seq"] for x in sent] == list(range(len(sent))) and sent[0]["marker"] and not sent[1]["marker"]


def test_cache_and_queue():
    s = folds.cache_start(2)
    s, _ = folds.cache_step(s, {"request": 1, "item": "a", "size": folds.UNIT + 1, "most": 1 << 30})
    s, out = folds.cache_step(s, {"request": 2, "item": "b", "size": 1, "most": 1 << 30})
    assert out[0]["evicted"] == 1 and out[0]["held_units"] == 1
    assert not folds.cache_step(s, {"request": 3, "item": "b", "size": 1, "most": 0})[1][0]["hit"]
    q, seen = folds.queue_start(2), []
    for i, kind in enumerate(["stateChanged", "stateChanged", "error", "nextNeeded"]):
        q, out = folds.queue_step(q, {"request": i, "kind": kind, "who": 1})
        seen.append(out[0]["dropped"])
    assert seen == [None, 0, None, 1]
    q = folds.queue_start(9)
    for i, who in enumerate([1, 2, 2, 1]):
        q, out = folds.queue_step(q, {"request": i, "kind": "stateChanged", "who": who})
    assert [x[0] for x in q["held"]] == [0, 2, 3]  # another stream's state isn't merged
    q, out = folds.queue_step(q, {"request": 9, "kind": "drain", "who": 1})
    assert out[0]["held"] == 2 and [x[0] for x in q["held"]] == [2]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i * 20 + (300 if i > 5 else 0), i) for k in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "stream_id long, at_ms long, event_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    args = ("stream_id", ["at_ms", "event_id"], folds.playout_step, folds.playout_start, folds.PLAYOUT)
    live = folds.fold_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), *args)
    q = live.writeStream.format("memory").queryName("playout").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, folds.fold(df, *args).collect()))
    assert sorted(map(tuple, spark.sql("SELECT * FROM playout").collect())) == want


def test_gap_frames_whole(spark):
    sent = spark.createDataFrame([(1, 0), (1, 2001), (1, 2021), (2, 5), (2, 100_025)], "k long, at long")
    got = sorted(tuple(r) for r in S.gap_frames(sent, "k", "at", 20).collect())
    assert got == [(1, t) for t in range(20, 2001, 20)] + [(2, t) for t in range(25, 100_025, 20)]


def test_keepalive_frames_whole(spark, tmp_path):
    spark.createDataFrame([(7, 0), (7, 10_000)], "user_id long, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(r["fill_at"] for r in catalogue.QUERIES["keepalive_frames"](spark, str(tmp_path)).collect())
    assert got == list(range(20, 10_000, 20))


def test_gap_frames_cut_anywhere(spark):
    rows = [(k, t * (k + 7) % 4001 - 2000) for k in range(9) for t in range(0, 60, 2 + k)] + [(3, 5), (3, 5), (None, -40), (None, 30), (4, None)]
    want = []
    for k in {k for k, _ in rows}:
        at = sorted(t for x, t in rows if x == k and t is not None)
        want += [(k, t) for a, b in zip(at, at[1:], strict=False) for t in range(a + 7, b, 7)]
    for sizes in ({}, {"window": 6, "block": 2, "rows": 50}, {"window": 1, "block": 1, "rows": 1}):
        got = [tuple(r) for r in S.gap_frames(spark.createDataFrame(rows, "k long, at int"), "k", "at", 7, **sizes).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), sizes
    assert S.gap_frames(spark.createDataFrame([], "k long, at long"), "k", "at", 20).count() == 0


def test_gap_frames_small_on_disk(spark, tmp_path):
    """Streams spread over the whole span: the rows' number grows with streams times span, so a row must take little."""
    sent = spark.range(20_000).select((F.xxhash64("id") % 500).alias("k"), (F.col("id") * 8).alias("at"))
    S.gap_frames(sent, "k", "at", 20).write.parquet(str(tmp_path / "out"))
    rows, size = spark.read.parquet(str(tmp_path / "out")).count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert rows > 3_000_000 and size < 1.5 * rows


def test_gap_frames_even_parts(spark):
    """The longest task is near the mean, and there are several for each core."""
    sent = spark.range(40_000).select((F.xxhash64("id") % 500).alias("k"), (F.col("id") * 8).alias("at"))
    tasks = [r["count"] for r in S.gap_frames(sent, "k", "at", 20).groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < 1.5 * sum(tasks) / len(tasks) and len(tasks) > 2 * spark.sparkContext.defaultParallelism


def test_gap_frames_one_long_gap(spark):
    """One stream's gap is filled by many tasks."""
    sent = spark.createDataFrame([(1, 0), (1, 20_000_001)], "k long, at long")
    tasks = S.gap_frames(sent, "k", "at", 20).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 1_000_000 and len(tasks) > 1


def play(step, state, *entries):
    out = []
    for entry in entries:
        state, made = step(state, entry)
        out += made
    return state, out


def test_pull_leases():
    at = lambda t, kind, **x: {"at_ms": t, "kind": kind, "generation": 1, "start_ms": 500, "paused": False, "ms": 20, "size": 100, "lease_id": 0, "outcome": "sent", **x}
    s, out = play(folds.pull_step, folds.pull_start(), at(0, "activate"), at(1, "pull"), at(2, "frame"), at(3, "frame"))
    assert [x["kind"] for x in out] == ["prebuffer_ready", "frame"] and out[1]["lease_id"] == 1 and out[1]["position_ms"] == 520
    s, out = play(folds.pull_step, s, at(4, "pull"))
    assert out[0]["code"] == "BUSY"
    s, out = play(folds.pull_step, s, at(5, "ack", lease_id=2))
    assert out[0]["code"] == "INVALID_CONFIG"
    s, out = play(folds.pull_step, s, at(6, "ack", lease_id=1), at(7, "pull"), at(23, "frame"))
    assert [(x["kind"], x["at_ms"]) for x in out] == [("ack", 6), ("frame", 23)] and s["media"]["due"] == 23 and s["stats"]["delivered"] == 1
    # A late ack keeps its lateness, so that the next pull drops what is stale.
    s, out = play(folds.pull_step, s, *[at(24, "frame")] * 9, at(300, "ack", lease_id=2), at(300, "pull"))
    frame = next(x for x in out if x["kind"] == "frame")
    assert frame["dropped"] == 8 and s["stats"]["recoveries"] == 1 and frame["late_ms"] == 300 - (43 + 160)
    # A new generation retires the lease; its ack counts once and moves nothing.
    s, out = play(folds.pull_step, s, at(301, "activate", generation=2), at(302, "ack", lease_id=3), at(303, "ack", lease_id=3))
    assert s["stats"]["delivered"] == 3 and s["media"]["sent"] == 0 and out[-1]["code"] == "INVALID_CONFIG"
    # An empty source ends, and a lease that is never acknowledged fails the output.
    s, out = play(folds.pull_step, s, at(400, "close", generation=2))
    assert [x["kind"] for x in out] == ["ended"] and s["media"] is None
    s, out = play(folds.pull_step, s, at(401, "activate", generation=3), at(402, "frame"), at(402, "frame"), at(403, "pull"), at(3000, "frame"))
    assert [x["kind"] for x in out] == ["prebuffer_ready", "frame", "failed"] and out[-1]["at_ms"] == 2403 and out[-1]["code"] == "OUTPUT_ERROR"


def test_playout_end():
    s, out = play(folds.playout_step, folds.playout_start(prebuffer_ms=100), {"at_ms": 0}, {"at_ms": 20}, {"at_ms": 40, "closed": True})
    assert [x["kind"] for x in out] == ["prebuffer_ready", "sent", "sent", "ended"] and out[-1]["at_ms"] == 80 and [x["at_ms"] for x in out[1:3]] == [40, 60]


def test_small_rules(spark):
    d = lambda x: F.lit(float(x))
    r = one(spark, N.volume_error(d(1.1)), N.volume_error(d("nan")), N.volume_error(d(0)), N.gain_error(d(-60)), N.gain_error(d(12.1)), N.capped_u32(F.lit(1 << 33)), N.projected_rtp(F.lit(4294967000), F.lit(0), F.lit(20_000)), N.report_percent_ms(F.lit(64), F.lit(1500), F.lit(None).cast("long")))
    assert r[:7] == ("INVALID_CONFIG", "INVALID_CONFIG", None, None, "INVALID_CONFIG", 4294967295, 664) and tuple(r[7]) == (25.0, 1.5, None)
    loud = one(spark, A.apply_volume(F.array(d(0.9)), 2.0, limiter=False), A.apply_volume(F.array(d(0.9)), 2.0))
    assert loud[0] == [1.0] and loud[1][0] < 1.0


def test_audio_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"")
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    asked = spark.createDataFrame([(f"file:{tmp_path}/{n}.wav",) for n in "abc"], "path string")
    own = tables.audio_files(spark, str(tmp_path), asked)
    assert [r["error"] for r in own.orderBy("path").collect()] == ["INVALID_SOURCE", None, "INVALID_SOURCE"]
    assert [r["error"] for r in tables.decode_from(own.drop("error")).orderBy("path").collect()] == ["INVALID_SOURCE", "DECODE_ERROR", "INVALID_SOURCE"]
    assert tables.audio_files(spark, str(tmp_path)).count() == 1


def test_encoders(spark):
    frames = spark.createDataFrame([(1, [0.0, 1.0, -1.0]), (2, None)], "id long, samples array<double>")
    got = {r["id"]: r["packet"] and bytes(r["packet"]).hex() for r in tables.encoded(frames, "pcm16").collect()}
    assert got == {1: "0000ff7f0080", 2: None}
    with pytest.raises(containers.NoDecoder):
        tables.encoded(frames, "opus")


def test_rounded_samples(spark, tmp_path):
    """Samples that come to zero keep their sign, and ties go away from zero, as in the SQL."""
    x = [-1e-9, 1e-9, -0.0, 0.0, -4.9e-8, -1e-11, 0.00390625, -0.00390625, 2.5 * 2.0**-24, 0.75, -0.3, 1e-3] * 5 + [-3e-11] * 4
    rows = [(i, v, i % 2) for i, v in enumerate([x, x[::-1], [-1e-10] * 64, [2.0**-k for k in range(64)]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("pcm_frames", "pcm_gain_clamp", "pcm_soft_limit", "pcm_downmix", "pcm_peak_dbfs", "pcm_layouts"):
        got = catalogue.QUERIES[name](spark, str(tmp_path)).toArrow()
        want = con.execute(catalogue.ORACLE_SQL[name]).to_arrow_table()
        text = lambda t: sorted(repr([r[c] for c in sorted(t.column_names)]) for r in t.to_pylist())  # noqa: B023, E731
        assert text(got) == text(want), name


def test_playlists_are_dealt_by_rows(spark, monkeypatch):
    """More rows make more tasks, not larger ones, through all windows and groups of a playlist."""
    for name in ("playlist_parse", "segment_delivery"):
        for rows, parts in ((1 << 20, 4), (100, -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100))):
            monkeypatch.setattr(S.dealt, "__kwdefaults__", {"rows": rows})
            out = catalogue.QUERIES[name](spark, SF)
            assert out.rdd.getNumPartitions() == parts, name

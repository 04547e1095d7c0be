from tonearm.streaming.session import apply, session_start


def track(name, **more):
    return {"id": name, "kind": "url", "seekable": True, **more}


def run(start, *rows):
    s, log = start, []
    for row in rows:
        s, actions, events, error = apply(s, row)
        log.append((actions, events, error))
    return s, log


def both(a="a", b="b"):
    s = session_start(track(a))
    s, *_ = apply(s, {"kind": "plan", "plan_version": 1, "current": track(a), "next": track(b)})
    return s


PLAY, PAUSE = {"kind": "play"}, {"kind": "pause"}


def test_ready_next_is_promoted():
    s, log = run(both(), PLAY, {"kind": "nextReady", "generation": 2}, {"kind": "ended", "generation": 1})
    assert s["current"]["track"]["id"] == "b" and log[-1][0] == ["startCurrent(2,2)"]


def test_pause_while_waiting():
    s, log = run(both(), PLAY, {"kind": "ended", "generation": 1}, PAUSE, PLAY)
    assert log[2][0] == ["pauseNext(2)"] and log[3][0] == ["resumeNext(2)", "armStartupDeadline(next,2,3)"] and "nextNeeded" not in log[3][1]


def test_pause_then_ready():
    s, log = run(both(), PLAY, {"kind": "ended", "generation": 1}, PAUSE, {"kind": "nextReady", "generation": 2}, PLAY)
    assert log[3][0] == ["startCurrent(2,3)"] and log[4][0] == ["resumeCurrent(2)", "armStartupDeadline(current,2,4)"] and s["state"] == "buffering"


def test_failures():
    s, log = run(session_start(track("a")), {"kind": "failed", "generation": 1, "code": "SOURCE_AUTH_EXPIRED"})
    assert log[0][1] == ["attemptFailed(a,SOURCE_AUTH_EXPIRED)", "stateChanged", "sourceRefreshNeeded(current,a)"]
    s, log = run(s, {"kind": "refresh", "current": track("z")}, {"kind": "refresh", "current": track("a")})
    assert log[0][2] == "INVALID_SOURCE" and s["state"] == "buffering"
    s, log = run(session_start(track("a")), {"kind": "failed", "generation": 1, "code": "INVALID_SOURCE"})
    assert s["state"] == "idle" and log[0][0] == ["cancelCurrent(1)"] and log[0][1][-1] == "nextNeeded"
    s, log = run(both(), PLAY, {"kind": "outputFailed", "code": "OUTPUT_ERROR"}, PLAY)
    assert s["state"] == "stopped" and log[1][0] == [] and log[2][2] == "UNSUPPORTED"


def test_plan_versions_and_promotion():
    s, log = run(both(), PLAY, {"kind": "plan", "plan_version": 2, "current": track("b"), "next": track("c")}, {"kind": "plan", "plan_version": 1, "current": None})
    assert s["current"]["generation"] == 2 and s["version"] == 2 and log[-1][0] == []
    s, log = run(session_start(track("a")), {"kind": "plan", "plan_version": 1, "current": track("b")}, {"kind": "ended", "generation": 1})
    assert log[0][0] == ["startCurrent(2,1)"] and s["current"]["track"]["id"] == "b"


def test_timeouts_know_their_epoch():
    late = {"kind": "timeout", "source_role": "current", "generation": 1, "watchdog_epoch": 1}
    s, log = run(session_start(track("a")), PLAY, PAUSE, late, PLAY, late)
    assert s["state"] == "buffering" and not any("attemptFailed" in e for _, events, _ in log for e in events)


def test_seek_and_live():
    s, log = run(session_start(track("a")), {"kind": "seek", "seek_s": 42})
    assert s["current"]["generation"] == 2 and s["played_ms"] == 42_000
    _, log = run(session_start(track("l", kind="live")), {"kind": "seek", "seek_s": 5}, PAUSE)
    assert [e for *_, e in log] == ["NOT_SEEKABLE", "UNSUPPORTED"]
    s, log = run(session_start(track("a")), PLAY, PAUSE, {"kind": "prebufferReady", "generation": 1}, PLAY)
    assert log[-1][0] == ["resumeCurrent(1)"] and s["state"] == "playing"


def test_levels_reach_active_slots():
    _, log = run(both(), {"kind": "volume", "volume": 0.2}, PLAY, {"kind": "volume", "volume": 0.5})
    assert log[-1][0] == ["setCurrentVolume(1)", "setNextVolume(2)"]
    _, log = run(session_start(track("a")), {"kind": "volume", "volume": 0.2})
    assert log[0][0] == []


def live(spark, df, tmp_path, f, name):
    """The rows of ``f`` over a stream of the table's rows, a file a micro-batch."""
    rows = df.collect()
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return sorted(map(tuple, spark.table(name).collect()))


def test_streaming_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    from tonearm.streaming import windows as W

    base = datetime(2024, 1, 1)
    rows = [(i % 2, base + timedelta(seconds=7 * i), i * 37 % 256, i * 1000, None if i % 5 == 0 else i * 10_000) for i in range(120)]
    df = spark.createDataFrame(rows, "stream long, at timestamp, fraction_lost long, jitter_us long, rtt_us long")
    f = lambda d: W.report_windows(d, "stream", "at")
    whole, seen = sorted(map(tuple, f(df).collect())), live(spark, df, tmp_path / "a", f, "windows")
    assert seen and set(seen) <= set(whole) and len(whole) - len(seen) <= 4  # the last windows wait for the watermark
    spans = lambda d: W.session_spans(d, "stream", "at", "20 seconds")
    gappy = df.where("minute(at) % 3 <> 1")
    assert set(live(spark, gappy, tmp_path / "b", spans, "spans")) <= set(map(tuple, spans(gappy).collect()))
    once = live(spark, df.select("stream", "at"), tmp_path / "c", lambda d: W.first_requests(d, "stream", "at", "1 hour"), "requests")
    assert sorted(r[0] for r in once) == [0, 1]

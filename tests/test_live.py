"""Live tables against the same tables at rest, for several splits into micro-batches and orders of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.operators import delivery, playlists, streams
from tonearm.streaming import ordered


def streamed(spark, tmp_path, batches, schema, f, name):
    """The rows that ``f`` of a live table has given after each of ``batches`` (whose times are above 0, the first watermark)."""
    ordered.use_state_store(spark)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(batches[0])
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = f(live.withColumn("at", F.timestamp_millis("ms"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    seen = []
    try:
        for i, rows in enumerate(batches):
            if i:
                put(rows)
            q.processAllAvailable()
            seen.append([tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()])
    finally:
        q.stop()
    return seen


def dealt(rng, rows, n, ms=0):
    """Rows in order, cut into ``n`` batches, and within the delay also out of order."""
    rows = sorted(rows, key=lambda r: r[ms] + rng.randrange(900))
    cuts = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]


def test_live_quality(spark, tmp_path):
    rng = random.Random(2)
    schema = "user_id long, ms long, event_id long, fraction_lost long, jitter_us long, rtt_us long"
    rows = [(rng.choice([1, 1, 2, 3]), 1000 + i // 3 * 250, i, rng.randrange(256), rng.randrange(90_000), rng.choice([None, rng.randrange(600_000)])) for i in range(150)]
    end = [(0, 10_000_000, 10**6, 0, 0, None)]
    want = streams.rolling_quality(spark.createDataFrame(rows, schema), "user_id", ["ms", "event_id"], 8)
    names = ["user_id", "event_id", "window_n", "window_loss", "window_max_loss", "window_jitter", "window_max_jitter", "window_rtt", "window_max_rtt", "level"]
    want = sorted(map(tuple, want.select(*names).collect()), key=str)
    for n in (2, 4):
        place = tmp_path / str(n)
        seen = streamed(spark, place, [*dealt(rng, rows, n, 1), end], schema, lambda df: ordered.live_quality(df, "user_id", "at", "event_id", 8, "1 second").select(*names), f"ring{n}")
        assert sorted(seen[-1], key=str) == want and 0 < len(seen[-2]) < len(want)


LOG = "user_id long, ms long, seq long, kind string, role string, generation long"


def plain_deadlines(rows, timeout):
    """One row after another, time by time."""
    out = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        attempts, paused, changes = {r: None for r in ordered.ROLES}, False, 0
        starts = dict.fromkeys(ordered.ROLES, 0)
        for t in range(0, max(r[1] for r in own) + timeout + 2):
            for _, _, _, kind, role, generation in [r for r in own if r[1] == t]:
                if kind == "start":
                    starts[role] += 1
                    attempts[role] = {"g": generation, "due": None if paused else t + timeout, "epoch": starts[role] + changes}
                elif kind in ("ready", "failed", "ended"):
                    if attempts[role] and attempts[role]["g"] == generation:
                        attempts[role] = None
                elif kind == "stop":
                    attempts, paused = dict.fromkeys(attempts), False
                else:
                    changes += 1
                    for r, a in attempts.items():
                        if a and kind == "pause":
                            a["due"] = None
                        elif a and paused:
                            a["due"], a["epoch"] = t + timeout, starts[r] + changes
                    paused = kind == "pause"
            for role, a in attempts.items():
                if a and a["due"] == t:
                    out.append((k, role, a["g"], a["epoch"], t, "SOURCE_TIMEOUT"))
                    attempts[role] = None
    return sorted(out)


def logs(rng, n):
    """Logs in which nothing falls on a deadline but at its own millisecond."""
    rows = []
    for i in range(n):
        kind = rng.choice(["start", "start", "start", "ready", "failed", "ended", "pause", "resume", "stop"])
        both = kind in ("pause", "resume", "stop")
        rows.append((rng.choice([1, 2, 3]), i * 7, i, kind, None if both else rng.choice(ordered.ROLES), None if both else rng.randrange(3)))
    return rows


def test_deadlines(spark):
    rng = random.Random(4)
    for timeout in (20, 70, 300):
        rows = logs(rng, 300)
        got = delivery.deadlines(spark.createDataFrame(rows, LOG), "user_id", ["ms", "seq"], "ms", timeout).collect()
        assert sorted(map(tuple, got)) == plain_deadlines(rows, timeout) != []


def test_live_deadlines(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, 1000 + ms * 100, *rest) for k, ms, *rest in logs(rng, 120)]
    end = [(0, 10_000_000, 10**6, "other", None, None)]
    want = sorted(map(tuple, delivery.deadlines(spark.createDataFrame(rows, LOG), "user_id", ["ms", "seq"], "ms", 3000).collect()))
    seen = streamed(spark, tmp_path, [*dealt(rng, rows, 3, 1), end], LOG, lambda df: ordered.live_deadlines(df, "user_id", "at", "seq", 3000, "1 second"), "deadlines")
    assert sorted(seen[-1]) == want and len(want) > 5


def test_a_deadline_fires_without_a_row_of_its_own(spark, tmp_path):
    first = [(1, 1000, 1, "start", "current", 7), (2, 1000, 2, "start", "current", 8), (2, 1500, 3, "pause", None, None), (3, 1000, 4, "start", "next", 9), (3, 2000, 5, "ready", "next", 9)]
    only_time = [(9, 60_000, 6, "other", None, None)]
    seen = streamed(spark, tmp_path, [first, only_time], LOG, lambda df: ordered.live_deadlines(df, "user_id", "at", "seq", 3000, "1 second"), "timer")
    assert seen == [[], [(1, "current", 7, 1, 4000, "SOURCE_TIMEOUT")]]


SNAPSHOTS = "playlist long, ms long, seq long, media_sequence long, uris array<string>, target long, end_list boolean"


def snapshots(rng, n):
    rows = []
    for k in (1, 2, 3):
        first = 0
        for i in range(n):
            first += rng.choice([0, 0, 1, 2, 9])
            size = rng.randrange(0, 6)
            rows.append((k, 1000 + i * 400 + k, i * 10 + k, first, [f"s{first + j}" for j in range(size)], rng.randrange(0, 14), i > n - 3 and rng.random() < 0.5))
    return rows


def plain_reloads(rows, depth=3):
    out = []
    for k in {r[0] for r in rows}:
        at = None
        for _, _, seq, first, uris, target, end in sorted(r for r in rows if r[0] == k):
            reload_ms = None if end else min(max(target * 500, 500), 5000)
            if at is None:
                at = first if end else max(first, first + len(uris) - depth)
            if at < first:
                out.append((k, seq, "skipped", at, first - at, None, reload_ms))
                at = first
            while at < first + len(uris):
                out.append((k, seq, "segment", at, 1, uris[at - first], reload_ms))
                at += 1
            if end:
                break
    return sorted(out, key=str)


def test_reloads(spark):
    rows = snapshots(random.Random(6), 40)
    got = playlists.reloads(spark.createDataFrame(rows, SNAPSHOTS), "playlist", ["ms", "seq"]).collect()
    assert sorted(map(tuple, got), key=str) == plain_reloads(rows) and {r["kind"] for r in got} == {"segment", "skipped"}


@pytest.mark.parametrize("n", [2, 4])
def test_live_reloads(spark, tmp_path, n):
    rng = random.Random(n)
    rows = snapshots(rng, 25)
    end = [(0, 10_000_000, 10**6, 0, [], 1, True)]
    seen = streamed(spark, tmp_path, [*dealt(rng, rows, n, 1), end], SNAPSHOTS, lambda df: ordered.live_reloads(df, "playlist", "at", "seq", late="1 second"), f"reloads{n}")
    assert sorted(seen[-1], key=str) == plain_reloads(rows)

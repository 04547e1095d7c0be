"""Ordered folds over keyed logs.

A fold is a pure ``step(state, row) -> (state, [out rows])``; ``fold`` runs it
over a table (a sorted run of each key, read batch by batch) and ``fold_stream``
over a stream, with the same step.  State is a plain dict.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def fold(df: DataFrame, key: str, order: list[str], step: Step, start: Callable[[], dict], schema: str) -> DataFrame:
    """The out rows of every key in order.  A key's rows are sorted on disk and streamed, never held whole."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), {}
        for frame in frames:
            out, columns = [], list(frame.columns)
            for values in zip(*(frame[c].tolist() for c in columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                if row[key] != now:
                    now, state = row[key], start()
                state, made = step(state, row)
                out += [{key: now, **x} for x in made]
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def fold_stream(df: DataFrame, key: str, order: list[str], step: Step, start: Callable[[], dict], schema: str) -> DataFrame:
    """The same over a stream: the state goes from one micro-batch to the next."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(k, frames, held):
        state = json.loads(held.get[0]) if held.exists else start()
        out = []
        for row in pd.concat(list(frames)).sort_values(order).to_dict("records"):
            state, made = step(state, row)
            out += [{key: k[0], **x} for x in made]
        held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


# Playout: frames that become available are sent at their deadlines.

PLAYOUT = "stream_id long, seq long, kind string, at_ms long, position_ms long, rtp_timestamp long, marker boolean, late_ms long"
FRAME_MS, FRAME_SAMPLES = 20, 960


def playout_start(prebuffer_ms: int = 100, max_late_ms: int = 100) -> dict:
    return {"queue": [], "due": None, "fresh": True, "seq": 0, "rtp": 0, "media": 0, "wall": None, "prebuffer": prebuffer_ms, "late": max_late_ms, "reported": False}


def _emit(s: dict, kind: str, at: int, marker: bool = False, late: int = 0) -> dict:
    return {"seq": s["seq"], "kind": kind, "at_ms": at, "position_ms": s["media"], "rtp_timestamp": s["rtp"], "marker": marker, "late_ms": late}


def _drained(s: dict, now: int, out: list[dict]) -> tuple[dict, list[dict]]:
    """A source has ended: what is queued starts without a full prebuffer and goes out, and then the stream is idle."""
    if s["queue"] and s["due"] is None:
        s["due"] = now
        if not s["reported"]:
            out.append(_emit(s, "prebuffer_ready", now))
            s["reported"] = True
    while s["queue"]:
        at = s["due"]
        if s["fresh"] and s["wall"] is not None:
            s["rtp"] = (s["rtp"] + max(0, at - s["wall"]) * FRAME_SAMPLES // FRAME_MS) % 2**32
        out.append(_emit(s, "sent", at, s["fresh"]))
        s["queue"].pop(0)
        s.update(fresh=False, seq=(s["seq"] + 1) % 65536, rtp=(s["rtp"] + FRAME_SAMPLES) % 2**32, media=s["media"] + FRAME_MS, wall=at + FRAME_MS, due=at + FRAME_MS)
    out.append(_emit(s, "ended", now if s["wall"] is None else max(now, s["wall"])))
    s.update(due=None, fresh=True, media=0, reported=False)
    return s, out


def playout_step(s: dict, row: dict) -> tuple[dict, list[dict]]:
    """One arrival at ``at_ms``: first everything that fell due before it, then the frame joins the queue.

    Late frames go while others follow, at most to within the lateness allowed, as one recovery; an empty queue at a
    deadline is an underrun and prebuffering begins again; a first packet's clock catches up with the wall."""
    s = dict(s, queue=list(s["queue"]))
    now, out = int(row["at_ms"]), []
    while s["due"] is not None and s["due"] <= now:
        at = s["due"]
        if not s["queue"]:
            out.append(_emit(s, "underrun", at))
            s.update(due=None, fresh=True)
            break
        at = max(at, s["queue"][0])
        late, dropped = at - s["due"], 0
        while late - dropped * FRAME_MS > s["late"] and len(s["queue"]) > 1:
            s["queue"].pop(0)
            dropped += 1
            out.append(_emit(s, "dropped", at, late=late))
            s.update(rtp=(s["rtp"] + FRAME_SAMPLES) % 2**32, media=s["media"] + FRAME_MS)
        if s["fresh"] and s["wall"] is not None:
            s["rtp"] = (s["rtp"] + max(0, at - s["wall"]) * FRAME_SAMPLES // FRAME_MS) % 2**32
        out.append(_emit(s, "sent", at, s["fresh"], late))
        s["queue"].pop(0)
        anchored = s["due"] + dropped * FRAME_MS + FRAME_MS
        s.update(
            fresh=False, seq=(s["seq"] + 1) % 65536, rtp=(s["rtp"] + FRAME_SAMPLES) % 2**32, media=s["media"] + FRAME_MS, wall=at + FRAME_MS, due=anchored if anchored > at else at + FRAME_MS
        )
    if row.get("closed"):
        return _drained(s, now, out)
    s["queue"].append(now)
    if s["due"] is None and len(s["queue"]) * FRAME_MS >= s["prebuffer"]:
        s["due"] = now
        if not s["reported"]:
            out.append(_emit(s, "prebuffer_ready", now))
            s["reported"] = True
    return s, out


# A byte-weighted cache, least recently used out first.

CACHE = "stream_id long, request long, hit boolean, evicted long, held_units long"
UNIT = 1 << 20


def cache_start(units: int = 64) -> dict:
    return {"units": units, "held": []}


def cache_step(s: dict, row: dict) -> tuple[dict, list[dict]]:
    """A request for ``item`` of ``size`` bytes by a caller that takes at most ``most``.

    An entry too large for the caller is a miss that leaves its place in the order alone."""
    held = [list(x) for x in s["held"]]
    at = next((i for i, x in enumerate(held) if x[0] == row["item"]), None)
    hit, evicted = at is not None and held[at][1] <= row["most"], 0
    if hit:
        held.append(held.pop(at))
    elif at is None:
        need = -(-row["size"] // UNIT)
        if need <= s["units"]:
            while sum(-(-x[1] // UNIT) for x in held) + need > s["units"]:
                held.pop(0)
                evicted += 1
            held.append([row["item"], row["size"]])
    return {**s, "held": held}, [{"request": row["request"], "hit": hit, "evicted": evicted, "held_units": sum(-(-x[1] // UNIT) for x in held)}]


# A bounded event queue.

QUEUE = "stream_id long, request long, dropped long, held long"
MERGED = ("stateChanged", "networkQualityChanged")


def queue_start(most: int = 4096) -> dict:
    return {"most": most, "held": []}


def queue_step(s: dict, row: dict) -> tuple[dict, list[dict]]:
    """Adjacent events of a mergeable kind and the same stream (``who``) keep the newest; when full, the oldest mergeable
    goes, else the oldest.  A drain takes the events of its stream, a drainAll everything."""
    kind, who, request = row["kind"], row["who"], row["request"]
    held = s["held"]  # the fold's own list
    if kind in ("drain", "drainAll"):
        kept = [x for x in held if kind == "drain" and x[2] != who]
        return {**s, "held": kept}, [{"request": request, "dropped": None, "held": len(held) - len(kept)}]
    gone = None
    if held and held[-1][1] == kind and held[-1][2] == who and kind in MERGED:
        gone = held.pop()[0]
    elif len(held) >= s["most"]:
        gone = held.pop(next((i for i, x in enumerate(held) if x[1] in MERGED), 0))[0]
    held.append((request, kind, who))
    return s, [{"request": request, "dropped": gone, "held": len(held)}]


# A queue bounded by duration, between a producer that waits and a consumer.

BOUNDED = "event_id long, user_id long, buffered_ms long, outcome string"


def bounded_start(capacity_ms: int = 400) -> dict:
    return {"capacity": capacity_ms, "held": [], "buffered": 0}


def bounded_step(s: dict, row: dict) -> tuple[dict, list[dict]]:
    """A frame of ``duration`` is queued, blocked while it doesn't fit, or an error if it never can; without one the oldest
    is sent; ``cleared`` drops all, as when the consumer goes."""
    d = None if row["duration"] is None or row["duration"] != row["duration"] else int(row["duration"])
    held, buffered = s["held"], s["buffered"]
    if row["cleared"]:
        held, buffered, outcome = [], 0, "cleared"
    elif d is None:
        outcome = "sent" if held else "empty"
        buffered -= held.pop(0) if held else 0
    elif d > s["capacity"]:
        outcome = "INVALID_CONFIG"
    elif buffered + d > s["capacity"]:
        outcome = "blocked"
    else:
        held.append(d)
        buffered, outcome = buffered + d, "queued"
    return {**s, "held": held, "buffered": buffered}, [{"event_id": row["event_id"], "buffered_ms": buffered, "outcome": outcome}]


# Turns of a decoder: chunks until there is enough, the source waits or ends.

TURNS = "user_id long, event_id long, turn long, decoded_ms long, closed string"


def turn_start(batch_ms: int = 80) -> dict:
    return {"batch": batch_ms, "turn": 1, "decoded": 0, "total": 0}


def turn_step(s: dict, row: dict) -> tuple[dict, list[dict]]:
    """A chunk of ``ms``; without one the source needs more (wait) or ends (end).  Nothing decoded at all is an error."""
    kind = row["kind"]
    decoded = s["decoded"] + (int(row["ms"]) if kind == "chunk" else 0)
    total = s["total"] + (int(row["ms"]) if kind == "chunk" else 0)
    closed = "batch" if kind == "chunk" and decoded >= s["batch"] else "need_more" if kind == "wait" else ("ended" if total else "DECODE_ERROR") if kind == "end" else None
    out = {"event_id": row["event_id"], "turn": s["turn"], "decoded_ms": decoded, "closed": closed}
    return {**s, "turn": s["turn"] + (closed is not None), "decoded": 0 if closed else decoded, "total": total}, [out]


# Frames that the host pulls, each under a lease until it is acknowledged.

PULL = "stream_id long, at_ms long, kind string, lease_id long, generation long, position_ms long, late_ms long, dropped long, delivered long, code string"
LEASE_MS = 2000


def pull_start(prebuffer_ms: int = 40, late_ms: int = 100) -> dict:
    zero = {"delivered": 0, "bytes": 0, "dropped": 0, "dropped_ms": 0, "recoveries": 0, "underruns": 0, "most_late": 0}
    return {"prebuffer": prebuffer_ms, "late": late_ms, "media": None, "paused": False, "waiting": False, "lease": None, "next": 1, "stats": zero}


def _pull_row(s: dict, kind: str, at: int, **x) -> dict:
    m = s["media"] or {}
    row = {"at_ms": at, "kind": kind, "lease_id": None, "generation": m.get("generation"), "position_ms": None, "late_ms": None, "dropped": s["stats"]["dropped"], "delivered": s["stats"]["delivered"], "code": None}
    return {**row, **x}


def _pull_ready(s: dict, now: int, out: list) -> None:
    """Starts media that has buffered enough, ends what is drained, and serves a pull whose time has come."""
    m = s["media"]
    if not m:
        return
    buffered = sum(d for d, _ in m["queue"])
    if not m["started"] and not s["paused"] and (buffered >= s["prebuffer"] or (m["closed"] and buffered)):
        m["started"], m["due"] = True, now
        if not m["reported"]:
            m["reported"] = True
            out.append(_pull_row(s, "prebuffer_ready", now))
    if m["closed"] and not m["queue"] and not s["lease"]:
        s["media"] = None
        out.append(_pull_row(s, "ended", now, generation=m["generation"]))
        return
    if not (s["waiting"] and m["started"] and not s["paused"] and not s["lease"] and m["due"] is not None and m["due"] <= now):
        return
    stats, due, first = s["stats"], m["due"], s["stats"]["dropped"]
    stats["most_late"] = max(stats["most_late"], now - due)
    while now - due > s["late"] and len(m["queue"]) > 1:
        d, _ = m["queue"].pop(0)
        stats["dropped"] += 1
        stats["dropped_ms"] += d
        m["sent"] += d
        due += max(1, d)
    stats["recoveries"] += stats["dropped"] > first
    if not m["queue"]:
        stats["underruns"] += 1
        m["started"], m["due"] = False, None
        out.append(_pull_row(s, "underrun", now))
        return
    d, size = m["queue"].pop(0)
    s["lease"] = {"id": s["next"], "generation": m["generation"], "ms": d, "bytes": size, "at": now, "until": now + LEASE_MS, "retired": False}
    s["next"] = s["next"] % (2**32 - 1) + 1
    s["waiting"], m["due"] = False, due
    out.append(_pull_row(s, "frame", now, lease_id=s["lease"]["id"], position_ms=m["start"] + m["sent"] + d, late_ms=now - due))


def _pull_ack(s: dict, now: int, row: dict, out: list) -> None:
    lease, m, stats = s["lease"], s["media"], s["stats"]
    if lease is None or (lease["id"], lease["generation"]) != (row["lease_id"], row["generation"]):
        out.append(_pull_row(s, "ack", now, lease_id=row["lease_id"], code="INVALID_CONFIG"))
        return
    s["lease"], outcome = None, row["outcome"]

    def count() -> None:
        if outcome == "sent":
            stats["delivered"] += 1
            stats["bytes"] += lease["bytes"]
        elif outcome == "late":
            stats["dropped"] += 1
            stats["dropped_ms"] += lease["ms"]

    if outcome == "outputUnavailable":
        s["media"] = m if lease["retired"] else None
        out.append(_pull_row(s, "failed", now, generation=lease["generation"], code="OUTPUT_ERROR"))
    elif lease["retired"]:
        count()
    elif m and m["generation"] == row["generation"] and outcome in ("sent", "late"):
        m["sent"] += lease["ms"]
        count()
        d = max(1, lease["ms"])
        anchored = (now if m["due"] is None else m["due"]) + d
        # A consumer that acknowledges late keeps its lateness, so that its next pull drops what is stale.
        m["due"] = anchored if now - lease["at"] > d or anchored > now else now + d
    out.append(_pull_row(s, "ack", now, lease_id=lease["id"], generation=lease["generation"]))


def pull_step(s: dict, row: dict) -> tuple[dict, list[dict]]:
    """An entry at ``at_ms``: activate, deactivate, pause, resume (with a generation), frame (ms, size), close, pull, or ack
    (lease_id, generation, outcome).  A lease of a former generation is retired: its ack counts once and moves nothing."""
    now, kind, out = int(row["at_ms"]), row["kind"], []
    # What falls due before this entry: a waiting pull's deadline, or the lease's end.
    while True:
        m, lease = s["media"], s["lease"]
        if lease and lease["until"] <= now:
            s["lease"] = None
            out.append(_pull_row(s, "failed", lease["until"], lease_id=lease["id"], generation=lease["generation"], code="OUTPUT_ERROR"))
            s["media"], s["waiting"] = None, False
            continue
        if m and s["waiting"] and m["started"] and not s["paused"] and not lease and m["due"] is not None and m["due"] <= now:
            n = len(out)
            _pull_ready(s, m["due"], out)
            if len(out) > n:
                continue
        break
    m, mine = s["media"], s["media"] is not None and s["media"]["generation"] == row["generation"]
    if kind == "activate":
        if s["lease"]:
            s["lease"]["retired"] = True
        s["media"] = {"generation": int(row["generation"]), "start": int(row["start_ms"]), "queue": [], "closed": False, "started": False, "reported": False, "due": None, "sent": 0}
        s["paused"] = bool(row["paused"])
    elif kind == "deactivate" and mine:
        s["media"] = None
        if s["lease"]:
            s["lease"]["retired"] = True
    elif kind == "pause" and mine:
        s["paused"] = True
    elif kind == "resume" and mine:
        s["paused"], m["due"] = False, now
    elif kind == "frame" and m:
        m["queue"].append([int(row["ms"]), int(row["size"])])
    elif kind == "close" and m:
        m["closed"] = True
    elif kind == "pull":
        if s["waiting"] or s["lease"]:
            out.append(_pull_row(s, "pull", now, code="BUSY"))
        else:
            s["waiting"] = True
    elif kind == "ack":
        _pull_ack(s, now, row, out)
    _pull_ready(s, now, out)
    return s, out

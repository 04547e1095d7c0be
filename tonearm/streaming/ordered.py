"""Live streams in the order of their events, with timers: what a table at rest gives by windows, a stream gives as it comes.

Rows of a stream wait in list state until the watermark has passed them, and then go in order to a step that has typed state of
its own.  So any split into micro-batches, and any order of arrival within the watermark's delay, gives the same rows.  A timer
wakes a stream when the watermark comes to its next waiting row or to its next deadline; no row of its own is needed for that.

State is bounded by the rows within the watermark's delay and by each processor's own (a ring, two attempts, a number).
Sessions must use the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import numbers as N


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(v):
    """A value as Python has it; pandas turns integers with gaps into floats."""
    if isinstance(v, list | tuple) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return [_plain(x) for x in v]
    if v is None or v != v:
        return None
    return v.item() if hasattr(v, "item") else v


class InOrder(StatefulProcessor):
    """``waiting``: DDL of the rows as they come, the first column the event's millisecond, the second what orders equal ones.

    A subclass has ``columns`` (of its out rows), ``load`` and ``save`` of its state, ``step(row)`` and ``until(ms)``, which
    yields what deadlines before ``ms`` give, and ``next_due``."""

    waiting = ""
    columns: tuple[str, ...] = ()
    integers: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", self.waiting)
        self.names = [x.strip().split()[0] for x in self.waiting.split(",")]
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def load(self) -> None:
        pass

    def save(self) -> None:
        pass

    def until(self, ms: int) -> Iterator[tuple]:
        return iter(())

    def next_due(self) -> int | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            own = [frame[c].astype(object).tolist() for c in self.names]
            new += [tuple(self._typed(n, _plain(v)) for n, v in zip(self.names, row, strict=True)) for row in zip(*own, strict=True)]
        self.rows.appendList(new)
        self._wake(min(r[0] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = sorted(self.rows.get(), key=lambda r: tuple(r)[:2]) if self.rows.exists() else []
        ripe, rest = [r for r in every if r[0] < now], [tuple(r) for r in every if r[0] >= now]
        self.load()
        out: list[tuple] = []
        for row in ripe:
            out += self.until(row[0])
            out += self.step(row)
        out += self.until(now)
        self.save()
        if ripe:
            if rest:
                self.rows.put(rest)
            else:
                self.rows.clear()
        due = [x for x in (rest[0][0] if rest else None, self.next_due()) if x is not None]
        if due:
            self._wake(min(due) + 1)
        if out:
            made = pd.DataFrame(out, columns=list(self.columns))
            for c in set(self.integers) & set(self.columns):
                made[c] = made[c].astype("Int64")
            made.insert(0, "_key", key[0])
            yield made

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)

    def _typed(self, name: str, v):
        return int(v) if isinstance(v, float) and name in self.integers else v

    def step(self, row) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _run(df: DataFrame, key: str, at: str, late: str, processor: InOrder, columns: dict[str, object], out: str) -> DataFrame:
    """The processor's rows, with the key as it was named; ``columns``: what each row has besides its millisecond."""
    own = df.withWatermark(at, late).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.unix_millis(F.col(at)).alias("ms"), *[F.col(c).cast(t).alias(n) for n, (c, t) in columns.items()])
    kind = df.schema[key].dataType.simpleString()
    made = own.groupBy("_key").transformWithStateInPandas(processor, f"_key {kind}, {out}", "append", "EventTime")
    return made.withColumnRenamed("_key", key)


class QualityRing(InOrder):
    """The last reports of each stream; every report gives a row."""

    waiting = "ms long, seq long, fraction_lost long, jitter_us long, rtt_us long"
    columns = ("ms", "seq", "window_n", "loss_sum", "max_lost", "jitter_sum", "max_jitter", "rtt_sum", "rtts", "max_rtt")
    integers = (*columns, "fraction_lost", "jitter_us", "rtt_us")

    def __init__(self, length: int):
        self.length = max(1, length)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "fraction_lost long, jitter_us long, rtt_us long")

    def load(self) -> None:
        self.held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []

    def save(self) -> None:
        if self.held:
            self.ring.put(self.held)

    def step(self, row) -> Iterator[tuple]:
        self.held = [*self.held, tuple(row)[2:]][-self.length :]
        lost, jitter, rtt = ([x for x in c if x is not None] for c in zip(*self.held, strict=True))
        yield (row[0], row[1], len(self.held), sum(lost) if lost else None, max(lost, default=None), sum(jitter) if jitter else None, max(jitter, default=None), sum(rtt) if rtt else None, len(rtt), max(rtt, default=None))


def live_quality(reports: DataFrame, key: str, at: str, seq: str, length: int = 32, late: str = "30 seconds") -> DataFrame:
    """key, seq and the window_* columns and level of ``rolling_quality`` for every report of a live table, in the order of
    (at, seq): the last ``length`` reports of its stream."""
    made = _run(reports, key, at, late, QualityRing(length), {"seq": (seq, "long"), "fraction_lost": ("fraction_lost", "long"), "jitter_us": ("jitter_us", "long"), "rtt_us": ("rtt_us", "long")}, ", ".join(f"{c} long" for c in QualityRing.columns))
    n = F.col("window_n")
    out = made.select(
        key, F.col("seq").alias(seq), "window_n", (F.col("loss_sum") * 100.0 / (n * 256.0)).alias("window_loss"), N.loss_percent(F.col("max_lost")).alias("window_max_loss"), N.idiv(F.col("jitter_sum"), n).alias("window_jitter"),
        F.col("max_jitter").alias("window_max_jitter"), N.idiv(F.col("rtt_sum"), F.when(F.col("rtts") > 0, F.col("rtts"))).alias("window_rtt"), F.col("max_rtt").alias("window_max_rtt"),
    )
    return out.withColumn("level", N.quality_level(F.col("window_loss"), F.col("window_max_jitter"), F.col("window_rtt")))


ROLES = ("current", "next")


class Deadlines(InOrder):
    """The attempts of both roles; one that isn't ready in time gives a row, when the watermark has passed its deadline."""

    waiting = "ms long, seq long, kind string, role string, generation long"
    columns = ("role", "generation", "epoch", "due", "code")
    integers = ("generation", "epoch", "due", "ms", "seq")

    def __init__(self, timeout: int):
        self.timeout = timeout

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.switch = handle.getValueState("switch", "paused boolean, changes long")
        self.attempts = handle.getMapState("attempts", "role string", "generation long, starts long, pending boolean, due long, epoch long")

    def load(self) -> None:
        self.paused, self.changes = tuple(self.switch.get()) if self.switch.exists() else (False, 0)
        self.now = {r: list(self.attempts.getValue((r,))) if self.attempts.containsKey((r,)) else [None, 0, False, None, 0] for r in ROLES}

    def save(self) -> None:
        self.switch.update((self.paused, self.changes))
        for r, own in self.now.items():
            self.attempts.updateValue((r,), tuple(own))

    def next_due(self) -> int | None:
        return min((own[3] for own in self.now.values() if own[3] is not None), default=None)

    def until(self, ms: int) -> Iterator[tuple]:
        for role, own in sorted(self.now.items(), key=lambda x: (x[1][3] or 0, x[0])):
            if own[3] is not None and own[3] < ms:
                yield role, own[0], own[4], own[3], "SOURCE_TIMEOUT"
                own[2], own[3] = False, None

    def step(self, row) -> Iterator[tuple]:
        ms, _, kind, role, generation = tuple(row)
        if kind == "start" and role in self.now:
            starts = self.now[role][1] + 1
            self.now[role] = [generation, starts, True, None if self.paused else ms + self.timeout, starts + self.changes]
        elif kind in ("ready", "failed", "ended") and role in self.now:
            if self.now[role][0] == generation:
                self.now[role][2:4] = [False, None]
        elif kind == "pause":
            self.paused, self.changes = True, self.changes + 1
            for own in self.now.values():
                own[3] = None
        elif kind == "resume":
            was, self.paused, self.changes = self.paused, False, self.changes + 1
            for own in self.now.values():
                if was and own[2]:
                    own[3], own[4] = ms + self.timeout, own[1] + self.changes
        elif kind == "stop":
            self.paused = False
            for own in self.now.values():
                own[0], own[2], own[3] = None, False, None
        return iter(())


def live_deadlines(log: DataFrame, key: str, at: str, seq: str, timeout: int, late: str = "10 seconds") -> DataFrame:
    """key, role, generation, epoch, due, code of each attempt of a live log (kind, role, generation) that isn't ready ``timeout``
    milliseconds after it was armed: ``deadlines`` over a table that grows."""
    columns = {"seq": (seq, "long"), "kind": ("kind", "string"), "role": ("role", "string"), "generation": ("generation", "long")}
    return _run(log, key, at, late, Deadlines(timeout), columns, "role string, generation long, epoch long, due long, code string")


class Reloads(InOrder):
    """How far each playlist has been handed on."""

    waiting = "ms long, seq long, media_sequence long, n long, uris array<string>, target long, end_list boolean"
    columns = ("seq", "kind", "sequence", "n", "uri", "reload_ms")
    integers = ("seq", "sequence", "n", "reload_ms", "ms", "media_sequence", "target")

    def __init__(self, depth: int):
        self.depth = depth

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, ended boolean")

    def load(self) -> None:
        self.at, self.ended = tuple(self.place.get()) if self.place.exists() else (None, False)

    def save(self) -> None:
        if self.at is not None:
            self.place.update((self.at, self.ended))

    def step(self, row) -> Iterator[tuple]:
        _, seq, first, n, uris, target, end_list = tuple(row)
        if self.ended:
            return
        reload_ms = None if end_list else min(max(target * 500, 500), 5000)
        if self.at is None:
            self.at = first if end_list else max(first, first + n - self.depth)
        if self.at < first:
            yield seq, "skipped", self.at, first - self.at, None, reload_ms
            self.at = first
        for s in range(self.at, first + n):
            yield seq, "segment", s, 1, uris[s - first], reload_ms
        self.at, self.ended = max(self.at, first + n), bool(end_list)


def live_reloads(snapshots: DataFrame, key: str, at: str, seq: str, depth: int = 3, late: str = "10 seconds") -> DataFrame:
    """``reloads`` of a live table of playlist snapshots (media_sequence, uris, target, end_list)."""
    columns = {"seq": (seq, "long"), "media_sequence": ("media_sequence", "long"), "n": ("n", "long"), "uris": ("uris", "array<string>"), "target": ("target", "long"), "end_list": ("end_list", "boolean")}
    own = snapshots.withColumn("n", F.size("uris"))
    return _run(own, key, at, late, Reloads(depth), columns, "seq long, kind string, sequence long, n long, uri string, reload_ms long").withColumnRenamed("seq", seq)

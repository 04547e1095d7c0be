"""Slots, retries, attempts and hand-over rows of playing streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from .streams import as_of


def generation_slot(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A slot's log (kind: put, take or another; claim: a generation; initial: paused at a put) with what holds after each
    entry: generation (null for an empty slot), stopped (the generation that ended by this entry), effective (did it
    concern what the slot holds) and paused.

    Only entries that claim the slot's own generation act; a put always does.  A pause outlives a take."""
    kind, so_far = F.col("kind"), Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = log.withColumn("_epoch", F.sum(F.when(kind == "put", 1).otherwise(0)).over(so_far))
    epoch = Window.partitionBy(key, "_epoch").orderBy(*order)
    own = F.when(F.col("_epoch") > 0, F.first("claim").over(epoch))
    out = out.withColumn("_own", own).withColumn("_match", F.coalesce((F.col("claim") == F.col("_own")) & (kind != "put"), F.lit(False)))
    ended = F.coalesce(F.max((kind == "take") & F.col("_match")).over(epoch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    out = out.withColumn("_ended", ended).withColumn("effective", (kind == "put") | (F.col("_match") & ~F.col("_ended")))
    gone = F.col("_ended") | ((kind == "take") & F.col("effective"))
    out = out.withColumn("generation", F.when(~gone, F.col("_own")))
    before = F.lag("generation").over(Window.partitionBy(key).orderBy(*order))
    out = out.withColumn("stopped", F.when(kind == "put", before).when((kind == "take") & F.col("effective"), F.col("_own")))
    told = F.when(kind == "put", F.col("initial")).when((kind == "pause") & F.col("effective"), F.lit(True)).when((kind == "resume") & F.col("effective"), F.lit(False))
    return out.withColumn("paused", F.coalesce(as_of(out, key, order, told), F.lit(False))).drop("_epoch", "_own", "_match", "_ended")


def retried(attempts: DataFrame, request: str, most: Column) -> DataFrame:
    """request, tries, ok, code: of attempts (n from 0, ok, retryable, published, code) those that are made.  Another
    follows if this one failed, may be tried again, has handed out nothing, and tries are left."""
    stop = F.col("ok") | ~F.col("retryable") | F.col("published") | (F.col("n") >= most)
    own = attempts.groupBy(request).agg(F.min_by(F.struct("n", "ok", "code"), F.when(stop, F.col("n"))).alias("x"))
    return own.select(request, (F.col("x.n") + 1).alias("tries"), F.col("x.ok").alias("ok"), F.when(~F.col("x.ok"), F.col("x.code")).alias("code"))


def attempt_error(decoder_code: Column, decoder_at: Column, source_code: Column, source_at: Column, grace_ms: int = 250) -> Column:
    """A source's error goes before the decoder's result if it came first or within the grace after; one that only says the
    stream was closed counts if it came first alone.  A null ``source_at`` is a source that never ends."""
    first = source_at < decoder_at
    soon = (source_at >= decoder_at) & (source_at <= decoder_at + grace_ms) & (source_code != "STREAM_CLOSED")
    return F.when(F.coalesce(source_code.isNotNull() & (first | soon), F.lit(False)), source_code).otherwise(decoder_code)


def first_terminal(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, state: complete or failed by the first terminal entry (finish, fail, drop), or open."""
    own = log.groupBy(key).agg(F.min_by("kind", F.when(F.col("kind").isin("finish", "fail", "drop"), F.struct(*order))).alias("k"))
    return own.select(key, F.when(F.col("k") == "finish", "complete").when(F.col("k").isNull(), "open").otherwise("failed").alias("state"))


def promotions(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The entries with role (after each) and released: a next becomes current at its first promotion, which alone gives its
    preload permit back."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("kind") == "promote", 1).otherwise(0)).over(w)
    return log.withColumn("_n", n).withColumns({"role": F.when(F.col("_n") > 0, "current").otherwise("next"), "released": (F.col("kind") == "promote") & (F.col("_n") == 1)}).drop("_n")


#: The order in which kept events go out.
SLOTS = ("prebuffer", "terminal", "quality")


def pending_slots(log: DataFrame, key: str, order: list[str], slot: Column, flush: Column) -> DataFrame:
    """Between two flushes the newest event of each slot, in the order of the slots."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = log.withColumn("_flush", flush).withColumn("batch", F.sum(F.col("_flush").cast("int")).over(so_far)).where(~F.col("_flush")).withColumn("slot", slot)
    newest = out.groupBy(key, "batch", "slot").agg(F.max(F.struct(*order)).alias("x"))
    rank = F.array_position(F.array(*[F.lit(x) for x in SLOTS]), F.col("slot"))
    return newest.select(key, "batch", "slot", F.col(f"x.{order[-1]}").alias(order[-1]), F.row_number().over(Window.partitionBy(key, "batch").orderBy(rank)).alias("place"))


def startup_deadlines(log: DataFrame, key: str, order: list[str], at: str, timeout: int) -> DataFrame:
    """Of entries of kind start those whose deadline passes: no ready, pause or other start comes by then.  A pause makes
    the timer stale, so it never fires."""
    after = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    next_ = F.min(F.when(F.col("kind").isin("start", "ready", "pause"), F.col(at))).over(after)
    due = F.col(at) + timeout
    return log.withColumns({"_next": next_, "due": due}).where((F.col("kind") == "start") & (F.col("_next").isNull() | (F.col("_next") > F.col("due")))).drop("_next")


def deadlines(log: DataFrame, key: str, order: list[str], at: str, timeout: int) -> DataFrame:
    """key, role, generation, epoch, due, code of each attempt that isn't ready in time, from a log of kind (start, ready, failed,
    ended; pause, resume, stop for both roles), role and generation.

    A start arms its role's deadline unless the stream is paused, and a resume those of attempts still waiting; a pause, a stop,
    another start of the role, or the same generation being ready, failed or ended by then makes it stale.  An attempt times out
    once.  The epoch counts the role's starts and the stream's pauses and resumes."""
    kind, both = F.col("kind"), F.col("kind").isin("pause", "resume", "stop")
    own = log.withColumn("role", F.explode(F.when(both, F.array(F.lit("current"), F.lit("next"))).otherwise(F.array("role"))))
    w = Window.partitionBy(key, "role").orderBy(*order)
    now, before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    starts = kind == "start"
    generation = F.when(starts, F.struct(F.col("generation").alias("g"))).when(kind == "stop", F.struct(F.lit(None).cast("long").alias("g")))
    own = own.withColumns({"_g": F.last(generation, ignorenulls=True).over(now)["g"], "_own": F.last(generation, ignorenulls=True).over(before)["g"]})
    closes = kind.isin("ready", "failed", "ended") & F.coalesce(F.col("generation") == F.col("_own"), F.lit(False))
    own = own.withColumn("_closes", closes)
    waits = F.when(starts, True).when(F.col("_closes") | (kind == "stop"), False)
    paused = F.when(kind == "pause", True).when(kind.isin("resume", "stop"), False)
    last = lambda c, over: F.coalesce(F.last(c, ignorenulls=True).over(over), F.lit(False))
    changes = F.sum(F.when(kind.isin("start", "pause", "resume"), 1).otherwise(0)).over(now)
    own = own.withColumns({"_waits": last(waits, now), "_paused": last(paused, before), "epoch": changes.cast("long"), "_attempt": F.sum(F.when(starts, 1).otherwise(0)).over(now)})
    ends = starts | F.col("_closes") | kind.isin("pause", "stop")
    own = own.withColumns({"_next": F.min(F.when(ends, F.col(at))).over(after), "due": F.col(at) + timeout})
    arms = (starts & ~F.col("_paused")) | ((kind == "resume") & F.col("_paused") & F.col("_waits"))
    late = own.where(arms & (F.col("_next").isNull() | (F.col("_next") > F.col("due"))))
    first = Window.partitionBy(key, "role", "_attempt").orderBy(*order)
    late = late.withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return late.select(key, "role", F.col("_g").alias("generation"), "epoch", "due", F.lit("SOURCE_TIMEOUT").alias("code"))


def split_bytes(chunks: DataFrame, size: str, most: int) -> DataFrame:
    """Each chunk as pieces of at most ``most`` bytes: piece (from 0), at and length."""
    n = N.idiv(F.col(size) + (most - 1), most)
    out = chunks.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).where(F.col(size) > 0)
    return out.withColumn("at", F.col("piece") * most).withColumn("length", F.least(F.lit(most), F.col(size) - F.col("at")))


def spool_read(offset: Column, wanted: Column, available: Column, state: Column) -> tuple[Column, Column]:
    """What a reader of a growing file gets, and how many bytes: read, wait, eof or error."""
    n = F.least(wanted, available - offset)
    return F.when(n > 0, "read").when(state == "failed", "error").when(state == "complete", "eof").otherwise("wait"), F.when(n > 0, n).otherwise(0)


def live_retry(delivered: Column, attempt: Column, most: Column, retryable: Column) -> Column:
    """A live response is asked for again only while nothing of it has been handed on."""
    return (delivered == 0) & (attempt < most) & retryable


def cache_path(cached: Column, flight: Column, cached_after: Column) -> Column:
    """hit, follow, late_hit (found after waiting to be admitted) or lead."""
    return F.when(cached, "hit").when(flight, "follow").when(cached_after, "late_hit").otherwise("lead")


def frame_handover(lease: Column, deadline_ns: Column, now_ns: Column, clock_ns: Column) -> Column:
    """A frame as it is handed out: what is left of its deadline, and that on the host's clock."""
    left = F.greatest(deadline_ns - now_ns, F.lit(0))
    return F.struct(lease.alias("lease_id"), left.alias("remaining_ns"), N.saturating_add(clock_ns, left).alias("deadline_ns"))


def pull_progress(start_ms: Column, sent_ms: Column, frames: Column, n_bytes: Column) -> Column:
    """A pulled stream's progress has no RTP numbers and no report."""
    return F.struct(
        N.saturating_add(start_ms, sent_ms).alias("position_ms"), frames.alias("packets_sent"), n_bytes.alias("bytes_sent"), F.lit(0).alias("sequence"), F.lit(0).cast("long").alias("rtp_timestamp"),
        F.lit(None).cast("string").alias("report"),
    )


def event_rows(events: DataFrame) -> DataFrame:
    """Events (kind and every field) as flat rows in which a kind has its own fields alone."""
    kind = F.col("kind")
    of = lambda name, *kinds: F.when(kind.isin(*kinds), F.col(name)).alias(name)
    attempt, failed = ("sourceRefreshNeeded", "attemptFailed"), ("attemptFailed", "error")
    return events.select(
        "sequence", kind.alias("type"), "stream_id", of("status", "stateChanged"), of("attempt_id", *attempt), of("track_id", *attempt), of("source_role", *attempt), of("generation", *attempt),
        of("quality", "networkQualityChanged"), of("jitter_ms", "networkQualityChanged"), of("code", *failed), of("message", *failed),
    )


def median_of(df: DataFrame, key: str, order: list[str], size: int = 7) -> DataFrame:
    """The middle row of each group of ``size`` rows."""
    w = Window.partitionBy(key)
    placed = df.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(*order)))
    return placed.where((F.col("_n") == size) & (F.col("_at") == size // 2 + 1)).drop("_n", "_at")


def failure_summary(failures: DataFrame, key: str, order: list[str], text: str, most: int = 8) -> DataFrame:
    """key, message: how many failed, the first few, and how many more."""
    first = failures.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_at") <= most)
    said = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", text))), lambda x: x[text]), "; ").alias("_said"))  # at most ``most``
    counts = failures.groupBy(key).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit("; "), (F.col("n") - most).cast("string"), F.lit(" additional failures omitted"))).otherwise("")
    return said.join(counts, key).select(key, F.concat(F.col("n").cast("string"), F.lit(" stream shutdown operation(s) failed: "), "_said", more).alias("message"))

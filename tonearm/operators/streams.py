"""Windows, rankings, lookups and de-duplication over stream tables.

Every function takes and gives DataFrames; orders end in a unique column so
that windows are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from .scans import scan


#: Rows of a part that is sorted several times over.
PART_ROWS = 1 << 17


def dealt(df: DataFrame, *keys: str, rows: int = PART_ROWS) -> DataFrame:
    """The rows by their keys, in as many parts as hold about so many rows each, so that what a task sorts doesn't grow with the
    table.  Windows and groups by these keys need no other shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def rolling_quality(reports: DataFrame, key: str, order: list[str], length: int = 32) -> DataFrame:
    """Adds window_* columns over the last ``length`` reports (fraction_lost, jitter_us, rtt_us) of a stream."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - max(1, length), 0)
    n, rtts = F.count("*").over(w), F.count("rtt_us").over(w)
    loss = F.sum("fraction_lost").over(w) * 100.0 / (n * 256.0)
    rtt = N.idiv(F.sum("rtt_us").over(w), rtts)
    out = reports.withColumns(
        {
            "window_n": n, "window_loss": loss, "window_max_loss": N.loss_percent(F.max("fraction_lost").over(w)), "window_jitter": N.idiv(F.sum("jitter_us").over(w), n),
            "window_max_jitter": F.max("jitter_us").over(w), "window_rtt": rtt, "window_max_rtt": F.max("rtt_us").over(w),
        }
    )
    return out.withColumn("level", N.quality_level(F.col("window_loss"), F.col("window_max_jitter"), F.col("window_rtt")))


def counter_delta(x: Column, key: str, order: list[str]) -> Column:
    """Growth since the sample before, never negative; 0 for the first."""
    before = F.lag(x).over(Window.partitionBy(key).orderBy(*order))
    return F.greatest(x - F.coalesce(before, x), F.lit(0).cast("long"))


def floor_percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The value at place floor((n - 1) * p) of the sorted values.  Equal values are counted first, so a key's window goes
    over its distinct values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(key)
    ranked = counted.select(key, value, "_c", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("_to"), F.sum("_c").over(w).alias("_n"))
    at = lambda p: F.floor((F.col("_n") - 1) * F.lit(p))
    inside = lambda p: (at(p) < F.col("_to")) & (at(p) >= F.col("_to") - F.col("_c"))
    return ranked.groupBy(key).agg(F.sum("_c").alias("n"), *[F.max(F.when(inside(p), F.col(value))).alias(name) for name, p in shares.items()])


def version_gate(df: DataFrame, key: str, order: list[str], version: str) -> DataFrame:
    """Rows whose version is above every version before (0 at first)."""
    before = F.max(version).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col(version) > F.col("_before")).drop("_before")


def as_of(df: DataFrame, key: str, order: list[str], value: Column) -> Column:
    """The last non-null value up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def coalesce_adjacent(df: DataFrame, order: list[str], kind: str, key: str, kinds: tuple[str, ...], shard: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Drops a row of one of ``kinds`` that the next row repeats (same kind and key): of a run the newest stays.

    ``shard`` splits the log where rows can't be merged (a drain); without it the log is one ordered whole.  ``bucket`` (a day,
    say) must not decrease along the order: a shard is then dealt by it, and the last row of a bucket looks at the first of
    the next, of which there is one row a bucket."""
    df = df.withColumns({"_shard": shard if shard is not None else F.lit(0), "_bucket": bucket if bucket is not None else F.lit(0)})
    w = Window.partitionBy("_shard", "_bucket").orderBy(*order)
    row = F.struct(F.col(kind).alias("kind"), F.col(key).alias("key"))
    heads = df.groupBy("_shard", "_bucket").agg(F.min_by(row, F.struct(*order)).alias("_head"))
    heads = heads.select("_shard", "_bucket", F.lead("_head").over(Window.partitionBy("_shard").orderBy("_bucket")).alias("_head"))
    out = df.withColumn("_next", F.lead(row).over(w))
    if bucket is not None:
        out = out.join(heads, ["_shard", "_bucket"]).withColumn("_next", F.coalesce("_next", "_head")).drop("_head")
    same = (F.col("_next.kind") == F.col(kind)) & (F.col("_next.key") == F.col(key)) & F.col(kind).isin(*kinds)
    return out.where(~F.coalesce(same, F.lit(False))).drop("_next", "_shard", "_bucket")


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def single_flight(df: DataFrame, key: Column, order: list) -> DataFrame:
    """Adds leads: is this the first request of its transfer."""
    return df.withColumn("leads", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def status_lookup(ids: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Every asked id, duplicates kept, with its status; BUSY while it is starting, or STREAM_NOT_FOUND."""
    out = ids.join(status, key, "left").withColumn("code", F.when(F.col("state").isNull(), "STREAM_NOT_FOUND").when(F.col("starting"), "BUSY"))
    return out.withColumn("ok", F.col("code").isNull()).withColumn("generation", F.when(F.col("ok"), F.col("generation")))


def islands(start: Column, key: list[str], order: list[str]) -> Column:
    """A running number of the runs that begin where ``start`` holds."""
    return F.sum(F.when(F.coalesce(start, F.lit(False)), 1).otherwise(0)).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def byte_offsets(segments: DataFrame, playlist: str, order: list[str]) -> DataFrame:
    """Implicit offsets: a ranged segment without one goes on after the segment just before, if that had the same uri
    and a range.  Adds offset and error (of segments that have nothing to go on from, or an empty range)."""
    w = Window.partitionBy(playlist).orderBy(*order)
    follows = (F.lag("uri").over(w) == F.col("uri")) & F.lag("range_len").over(w).isNotNull()
    fresh = F.col("range_off").isNotNull() | ~F.coalesce(follows, F.lit(False))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = segments.withColumns({"_fresh": fresh, "_to": F.coalesce(F.sum("range_len").over(so_far), F.lit(0)) - F.coalesce("range_len", F.lit(0))})
    # What a run began with against the lengths up to there; one order serves all windows.
    begun = F.last(F.when(F.col("_fresh"), F.struct((F.col("range_off") - F.col("_to")).alias("base"))), ignorenulls=True).over(so_far)
    out = out.withColumn("offset", begun["base"] + F.col("_to"))
    bad = F.col("range_len").isNotNull() & (F.col("offset").isNull() | (F.col("range_len") <= 0))
    return out.withColumn("error", F.when(bad, "INVALID_SOURCE")).drop("_fresh", "_to")


def live_edge(segments: DataFrame, playlist: str, order: list[str], end_list: Column, depth: int = 3) -> DataFrame:
    """All of a finished playlist; of a live one the last few."""
    from_end = F.row_number().over(Window.partitionBy(playlist).orderBy(*[F.desc(c) for c in order]))
    return segments.withColumn("_left", from_end).where(end_list | (F.col("_left") <= depth)).drop("_left")


def choose_media(variants: DataFrame, renditions: DataFrame, master: str, order: str) -> DataFrame:
    """master, branch and order column of what each master playlist plays: the best audio rendition, or else the best variant.

    Variants have audio_group, rank (0 verified, 1 unknown, 2 unsupported), bandwidth, has_video, is_i_frame; renditions
    audio_group, uri, is_default, autoselect, channel_rank.  A group's rank and bandwidth are the least of its variants'."""
    groups = variants.where("audio_group IS NOT NULL").groupBy(master, "audio_group").agg(F.min("rank").alias("_rank"), F.min("bandwidth").alias("_bandwidth"))
    grouped = groups.select(master).distinct().withColumn("_grouped", F.lit(True))
    own = renditions.where("uri IS NOT NULL").join(groups, [master, "audio_group"], "left").join(grouped, master, "left")
    rank = F.coalesce("_rank", F.lit(1))
    own = own.where((F.col("_rank").isNotNull() | F.col("_grouped").isNull()) & (rank != 2))
    first = lambda *by: F.min(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(by)], F.col(order)))[order].alias(order)
    audio = own.groupBy(master).agg(first(rank, ~F.col("is_default"), ~F.col("autoselect"), F.col("channel_rank"), F.coalesce("_bandwidth", F.lit(N.I64))))
    rest = variants.where(~F.col("is_i_frame")).groupBy(master).agg(first(F.col("rank") == 2, F.col("has_video"), F.col("rank"), F.col("bandwidth")))
    met = rest.withColumnRenamed(order, "_variant").join(audio, master, "full")
    return met.select(master, F.when(F.col(order).isNotNull(), "rendition").otherwise("variant").alias("branch"), F.coalesce(order, "_variant").alias(order))


def count_windows(chunks: DataFrame, key: str, order: list[str], value: str, size: int, long: bool = False, buckets: int | None = None) -> DataFrame:
    """Tumbling windows of ``size`` values across rows of arrays; the last is padded with zeros.

    A row is placed by the lengths before it and cut at the windows' edges, so values are never rows.  ``long``: a stream may
    have any share of the rows, and lies in many tasks."""
    own = chunks.where(F.size(value) > 0)
    if long:
        placed = scan(own.select(key, *order, value), [key], order, sums={"_to": F.size(value).cast("long")}, buckets=buckets).withColumn("_at", F.col("_to") - F.size(value))
    else:
        before = F.coalesce(F.sum(F.size(value)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = own.withColumn("_at", before)
    at = F.col("_at")
    frames = placed.withColumn("frame", F.explode(F.sequence(N.idiv(at, size), N.idiv(at + F.size(value) - 1, size))))
    low = F.greatest(F.col("frame") * size - at, F.lit(0))
    high = F.least((F.col("frame") + 1) * size - at, F.size(value))
    cut = frames.select(key, "frame", (at + low).alias("_at"), F.slice(value, (low + 1).cast("int"), (high - low).cast("int")).alias("_v"))
    whole = cut.groupBy(key, "frame").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"])).alias("_v"))  # one frame's values
    padded = F.concat("_v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("_v")))
    return whole.select(key, "frame", (F.col("frame") * size).alias("position"), F.size("_v").alias("n_values"), padded.alias("samples"))


def primed(frames: DataFrame, key: str, order: list[str], produced: str, prime: Column) -> DataFrame:
    """The row at which each source has produced enough, or its last; ready if there is anything, ended_short if not enough."""
    enough = (F.col(produced) >= prime) & (F.col(produced) > 0)
    at = F.struct(*order)
    row = F.struct(*frames.columns)
    out = frames.groupBy(key).agg(F.min_by(row, F.when(enough, at)).alias("_first"), F.max_by(row, at).alias("_last"), F.bool_or(enough).alias("_any"))
    out = out.select(F.when(F.col("_any"), F.col("_first")).otherwise(F.col("_last")).alias("x"), (~F.col("_any")).alias("_short")).select("x.*", "_short")
    none = F.col(produced) == 0
    return out.withColumns({"ready": ~none, "ended_short": F.col(produced) < prime, "code": F.when(none, "DECODE_ERROR")}).drop("_short")


def shared_transfer(log: DataFrame, flight: str, who: str, order: list[str]) -> DataFrame:
    """After each entry of a transfer's log (kind: subscribe, leave, pause, resume, promote): its subscribers, those not
    paused, whether it has ever had a current one, and its gate (running while any isn't paused, cancelled when the last
    leaves).  What a subscriber that isn't there asks for is ignored."""
    kind = F.col("kind")
    own = Window.partitionBy(flight, who).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(False))
    here = last(F.when(kind == "subscribe", F.lit(True)).when(kind == "leave", F.lit(False)))
    awake = last(F.when(kind.isin("subscribe", "resume"), F.lit(True)).when(kind == "pause", F.lit(False)))
    out = log.withColumn("_here", here).withColumn("_active", F.col("_here") & awake)
    step = lambda c: F.col(c).cast("int") - F.coalesce(F.lag(c).over(own), F.lit(False)).cast("int")
    out = out.withColumns({"_dh": step("_here"), "_da": step("_active")})
    whole = Window.partitionBy(flight).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns(
        {"subscribers": F.sum("_dh").over(whole), "active": F.sum("_da").over(whole), "current_priority": F.bool_or((kind == "promote") & F.col("_here")).over(whole)}
    )
    gate = F.when(F.col("subscribers") == 0, F.when(F.col("_dh") < 0, "cancelled").otherwise("idle")).when(F.col("active") > 0, "running").otherwise("paused")
    return out.withColumn("gate", gate).drop("_here", "_active", "_dh", "_da")


def long_runs(df: DataFrame, key: str, order: list[str], bad: Column, most: int) -> DataFrame:
    """Runs of more than ``most`` consecutive bad rows of a stream."""
    out = df.withColumn("_bad", bad).withColumn("_run", islands(~bad, [key], order)).where("_bad")
    return out.groupBy(key, "_run").agg(F.count("*").alias("length"), F.min(order[-1]).alias("first")).where(F.col("length") > most).drop("_run")


#: Instants of a window and of a block in it, and rows of a part, when gaps are filled.
GAP_WINDOW, GAP_BLOCK, GAP_ROWS = 2048, 128, 1 << 25


def cut_runs(runs: DataFrame, step: int, width: int) -> DataFrame:
    """Runs of ``_n`` instants from ``_first`` on, cut where a span of ``width`` begins."""
    low = F.pmod("_first", F.lit(width))
    before = lambda j: N.idiv(j * width - low + (step - 1), step)
    cuts = runs.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), N.idiv(low + (F.col("_n") - 1) * step, width))))
    start, end = F.greatest(F.lit(0).cast("long"), before(F.col("_j"))), F.least("_n", before(F.col("_j") + 1))
    return cuts.withColumns({"_first": F.col("_first") + start * step, "_n": end - start}).drop("_j")


def gap_frames(sent: DataFrame, key: str, at: str, step: int, window: int = GAP_WINDOW, block: int = GAP_BLOCK, rows: int = GAP_ROWS) -> DataFrame:
    """Instants every ``step`` between one row of a stream and the next.

    There can be far more of them than rows, up to the streams times the span, and then the result's size on disk is what counts.  So gaps
    are dealt by windows of time, and streams whose instants are the same follow each other block by block: column files then hold few
    different instants a part, in runs that repeat, and take a fifth to a sixteenth of the space.  A long gap goes to many tasks.
    """
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    gaps = sent.select(key, (F.col(at).cast("long") + step).alias("_first"), N.idiv(after - F.col(at) - 1, step).alias("_n")).where("_n > 0")
    # At most so many instants; a gap counts for a block at least, so that what a task sorts is bounded too.
    streams = sent.groupBy(key).agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.count(at).alias("_rows"))
    totals = streams.agg(F.sum(N.idiv(F.col("_high") - F.col("_low"), step) + F.col("_rows") * block), F.min("_low"), F.max("_high")).first()
    size, low, high = (x or 0 for x in totals)
    cores = sent.sparkSession.sparkContext.defaultParallelism
    # Some windows for each core, where the span is long enough, so that cores end together.
    wide = step * max(1, min(window, -(-(high - low) // (4 * cores * block * step)) * block))
    least, first, windows = max(cores, -(-size // rows)), low // wide, 1 + high // wide - low // wide
    shares = -(-least // windows)
    # Each share of a window is a part, or windows take turns: hashed, some parts would get several and others none.
    parts = windows * shares if shares > 1 else min(windows, max(least, 4 * cores))
    cell = (N.idiv(F.col("_first") - F.pmod("_first", F.lit(wide)), wide) - first) * shares + F.pmod(F.xxhash64(key), F.lit(shares))
    spans = cut_runs(gaps, step, wide).repartitionById(parts, F.pmod(cell, F.lit(parts)).cast("int"))
    # By block, instant within the step, instant: in one long, which sorts faster than three columns.
    within = F.pmod("_first", F.lit(block * step))
    place = F.col("_first") - within + F.pmod(within, F.lit(step)) * block + N.idiv(within, step)
    blocks = cut_runs(spans, step, block * step).sortWithinPartitions(place)
    return blocks.select(key, F.explode(F.sequence("_first", F.col("_first") + (F.col("_n") - 1) * step, F.lit(step).cast("long"))).alias("fill_at"))

"""Cumulative-snapshot collapse of logged conversations (operator 7).

Chat logs often hold the same conversation again after every turn.  Each turn
gets a hash of its place, role and text; a running xor of them is the hash of
the prefix that ends there (128 bits, in two halves).  A conversation whose
whole hash is a proper prefix hash of another is a snapshot and goes, by an
anti-join of distinct hashes; of equal conversations the smallest conv_id
stays.  What stays is rendered.

Defined results: rows with a null conv_id take no part; null roles and texts
count as empty; turns are ordered by turn (nulls first), then role and text,
so repeated rows are turns of their own; a text of any length is one turn;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized

#: The marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turns (of the conversation), role, text, h1, h2: the prefix hashes up to this turn."""
    own = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = own.withColumn("place", F.row_number().over(order))
    mark = lambda salt: F.xxhash64(F.lit(salt), "place", F.length("role"), "role", "text")
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.count("*").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return placed.select("conv_id", "place", turns.alias("turns"), "role", "text", F.bit_xor(mark(1)).over(so_far).alias("h1"), F.bit_xor(mark(2)).over(so_far).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of each conversation that is no prefix of a longer one."""
    key = ["place", "h1", "h2"]
    # Hashes only: no text is kept here.
    prefixes = materialized(ordered_turns(turns).select("conv_id", *key, "turns"))
    whole = prefixes.where("place = turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # Prefixes that a conversation goes on from; copies merge before they are shuffled.
    proper = prefixes.where("place < turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations in chat format."""
    own = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"),
    )
    own = own.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE), F.lit("\n"))
    return own.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "").alias("rendered"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    return render(turns, materialized(maximal(turns)))


#: DuckDB, comparing the turns themselves.
COLLAPSE_SQL = f"""
WITH conv AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
whole AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM conv GROUP BY turns),
prefix AS (SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM whole))
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_copies,
  array_to_string(list_transform(turns, lambda t: '{OPEN}' || t.role || chr(10) || t.text || '{CLOSE}' || chr(10)), '') AS rendered
FROM whole WHERE turns NOT IN (SELECT turns FROM prefix)
"""

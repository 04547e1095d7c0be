"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Token weights are summed into cells (source, language, topic).  A margin's
values have target shares: those named in ``targets`` theirs, the others what
is left, in proportion to a power of their own shares.  Rounds scale the cells
to the targets of one margin after another until every margin meets them.  A
document is then kept with the probability its cell's calibrated weight has
against its own, times ``keep``, which is lowered until no probability is over
one, so the sample has the targets' shares; the draw is a hash of the id, so it
is the same on every run and engine.

Only DataFrame functions are used.  Sums by margin go over the small table of
cells, whose size is the number of distinct combinations and not of documents.

Defined results: null sources, languages, texts and ids count as empty ones; a
null or empty text weighs one token; a text of any length is weighed whole; an
id that is repeated has one draw for all its rows; an empty table gives no rows;
a target whose value doesn't occur is left out and the others are scaled to one;
margins that can't all be met at once (cells that don't occur) are met as near as
``most_rounds`` come, the last one exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized

KEEP = 0.5
#: The farthest that a margin may be from its targets, and the rounds to get there.
ERROR, MOST_ROUNDS = 1e-12, 64
BROADCAST_CELLS = 50_000
#: Where no share is given, targets grow as this power of the margin's own share.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Target shares of tokens.
TARGETS = {"lang": {"en": 0.6}, "topic": {"license": 0.02}}


def tokens() -> Column:
    """Words, as one more than the white space characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1).cast("long")


def topic() -> Column:
    """What a text is about, as far as SQL can tell: licenses, the web, contacts, or prose, short or not."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has = lambda x: F.contains(text, F.lit(x))
    return F.when(has("icense") | has("opyright"), "license").when(has("http") | has("www."), "web").when(has("@"), "contact").when(F.length(text) < 600, "short").otherwise("prose")


def with_targets(cells: DataFrame, targets: dict[str, dict[str, float]], powers: dict[str, float]) -> DataFrame:
    """The cells with their base shares and their margins' targets; sums over few rows are read by the driver, one number each."""
    margins = list(powers)
    total = cells.agg(F.sum("tokens").cast("double")).first()[0]
    now = cells.select(*margins, (F.col("tokens") / F.lit(total or 1.0)).alias("base"))
    for m, power in powers.items():
        given = targets.get(m, {})
        named = F.coalesce(*[F.when(F.col(m) == v, F.lit(float(t))) for v, t in given.items()], F.lit(None).cast("double"))
        share = F.sum("base").over(Window.partitionBy(m))
        now = now.withColumn("named", named).withColumn("raw", F.when(F.col("named").isNull(), F.pow(share, F.lit(power))))
        each = now.groupBy(m).agg(F.max("raw").alias("raw"), F.max("named").alias("named"))
        raw, held = each.agg(F.sum("raw"), F.sum("named")).first()
        rest = max(0.0, 1 - sum(given.values()))
        # What is left goes to the others; all are scaled to one over the values that occur.
        one = (held or 0.0) + (rest if raw else 0.0)
        target = F.coalesce(F.col("named"), F.lit(rest) * F.col("raw") / F.lit(raw or 1.0)) / F.lit(one or 1.0)
        now = now.withColumn(f"target_{m}", target).drop("named", "raw")
    return now


def calibrated_cells(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """The margins' columns, base and weight (shares of the whole) of each cell (with column tokens)."""
    targets, powers = TARGETS if targets is None else targets, POWERS if powers is None else powers
    margins = list(powers)
    now = materialized(with_targets(cells, targets, powers).withColumn("weight", F.col("base")))
    for _ in range(0, most_rounds, 4):
        for m in margins * 4:
            now = now.withColumn("weight", F.col("weight") * F.col(f"target_{m}") / F.sum("weight").over(Window.partitionBy(m)))
        now = materialized(now)  # keeps the plan short
        off = [F.abs(F.sum("weight").over(Window.partitionBy(m)) - F.col(f"target_{m}")) for m in margins]
        if (now.select(F.greatest(*off).alias("off")).agg(F.max("off")).first()[0] or 0) < ERROR:
            break
    return now.select(*margins, "base", "weight")


def mixed(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] | None = None, details: bool = False) -> DataFrame:
    """The sampled documents with their own columns; with ``details`` row (those as a struct), tokens, topic, probability."""
    margin = lambda c: F.coalesce(docs[c], F.lit(""))
    named = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), tokens().alias("tokens"), margin("source").alias("source"), margin("lang").alias("lang"), topic().alias("topic")
    )
    cells = materialized(named.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")))
    made = calibrated_cells(cells, targets, powers)
    ratio = F.col("weight") / F.col("base")
    peak = made.agg(F.max(ratio)).first()[0]
    chance = materialized(made.select("source", "lang", "topic", (ratio * F.least(F.lit(float(keep)), 1 / F.lit(peak or 1.0))).alias("probability")))
    if chance.count() <= BROADCAST_CELLS:  # beyond that the join is dealt out, and a hot cell split
        chance = F.broadcast(chance)
    id_ = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary")
    draw = F.conv(F.substring(F.md5(id_), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    out = named.join(chance, ["source", "lang", "topic"]).where(draw < F.col("probability"))
    return out.select("row", "tokens", "topic", "probability") if details else out.select("row.*")


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability of every document sampled."""
    out = mixed(docs.select("doc_id", "text", "lang", "source"), details=True)
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.source", "row.lang", "topic", F.col("tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"))


def report_sql(keep: float = KEEP, targets: dict[str, dict[str, float]] = TARGETS, powers: dict[str, float] = POWERS, rounds: int = 24) -> str:
    """The same in DuckDB, the rounds written out."""
    steps = [
        """d AS (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l, length(t) - length(translate(t, ' ' || chr(10) || chr(9), '')) + 1 AS n_tokens,
  CASE WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'license' WHEN contains(t, 'http') OR contains(t, 'www.') THEN 'web'
    WHEN contains(t, '@') THEN 'contact' WHEN length(t) < 600 THEN 'short' ELSE 'prose' END AS p,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "c AS (SELECT s AS source, l AS lang, p AS topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "b AS (SELECT source, lang, topic, tokens / (SELECT sum(tokens) FROM c) AS base FROM c)",
    ]
    for m, p in powers.items():
        given = targets.get(m, {})
        cases = "".join(f" WHEN {m} = '{v}' THEN {t}::DOUBLE" for v, t in given.items())
        steps.append(f"n_{m} AS (SELECT {m}, CASE{cases or ' WHEN false THEN 0::DOUBLE'} END AS named, pow(sum(base), {p}::DOUBLE) AS raw FROM b GROUP BY {m})")
        steps.append(f"r_{m} AS (SELECT {m}, coalesce(named, {max(0.0, 1 - sum(given.values()))}::DOUBLE * raw / (SELECT sum(raw) FROM n_{m} WHERE named IS NULL)) AS t FROM n_{m})")
    shares = ", ".join(f"r_{m}.t / (SELECT sum(t) FROM r_{m}) AS target_{m}" for m in powers)
    steps.append(f"w0 AS (SELECT b.source, b.lang, b.topic, base, base AS weight, {shares} FROM b " + " ".join(f"JOIN r_{m} ON r_{m}.{m} = b.{m}" for m in powers) + ")")
    n = 0
    for _ in range(rounds):
        for m in powers:
            n += 1
            steps.append(f"w{n} AS MATERIALIZED (SELECT * REPLACE (weight * target_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM w{n - 1})")
    steps.append(f"w AS (SELECT source, lang, topic, weight / base * least({keep}::DOUBLE, 1 / (SELECT max(weight / base) FROM w{n})) AS probability FROM w{n})")
    return (
        "WITH " + ",\n".join(steps) + """
SELECT doc_id, d.source, d.lang, d.p AS topic, n_tokens::BIGINT AS n_tokens, round(probability, 6) AS probability
FROM d JOIN w ON w.source = d.s AND w.lang = d.l AND w.topic = d.p WHERE draw < probability"""
    )

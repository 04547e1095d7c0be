"""Document quality from a linear-chain CRF over lines (operator 5).

Every line of a text is good or bad.  Its emission weighs the features of the
line and of its two neighbours; a transition matrix ties the labels of
adjacent lines.  Forward-backward gives each line's marginal, and a document's
score is the mean marginal of its lines, weighted by their lengths.

Training maximises the conditional likelihood with each line labelled as its
document, over at most ``sample`` labelled documents of each class (those with
the lowest hash of the id, ties by id) and ``LINES`` lines of each.  As no
document in training has lines of both labels, the transitions learn to stay.

Defined results: a null or empty text is one empty line and gets a score; with
no usable label every score is 0.5; null ids count as the empty string for the
fold; repeated rows are scored alike, and a repeated id is learned once; labels
that are null are not learned, an id with both labels as each; a text of any
length is scored whole; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, pieces, texts_of

SAMPLE = 1500
#: Lines of a sampled document that training takes, in windows spread over it.
LINES, WINDOW = 2000, 100
#: The byte classes counted in each line.
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c",
    "stop": b".,;:?'\"-()", "bang": b"!", "symbol": b"#$%&*+/<=>@[]\\^_`{|}~", "wide": bytes(range(128, 256)),
}
OWN = 12


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lengths of the lines (at least 1), and lines of each text."""
    per_text = np.array([x.count("\n") + 1 for x in texts], np.int64)
    joined = "\n".join(texts)
    data = np.frombuffer((joined + "\n").encode(), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    n = (ends - starts).astype(np.float64)
    some = np.maximum(n, 1)
    counts = {}
    for name, members in CLASSES.items():
        member = np.zeros(256, bool)
        member[list(members)] = True
        counts[name] = np.add.reduceat(member[data], starts, dtype=np.int64).astype(np.float64)
    lines = joined.split("\n")
    words, kinds = np.empty(len(lines)), np.empty(len(lines))
    for i, line in enumerate(lines):
        own = line.split()
        words[i], kinds[i] = len(own), len(set(own))
    repeated = np.empty(len(lines))
    at = 0
    for m in per_text:
        repeated[at : at + m] = 1 - len(set(lines[at : at + m])) / m
        at += m
    letters = np.maximum(counts["upper"] + counts["lower"] + counts["wide"], 1)
    w = np.maximum(words, 1)
    f = np.stack(
        [
            counts["upper"] / letters, counts["digit"] / some, counts["symbol"] / some, counts["bang"] / some, counts["stop"] / some,
            np.minimum(counts["symbol"] / w, 3), np.minimum(counts["bang"] / w, 3), np.log1p(n) / 5, 1 - kinds / w, (words >= 8) * (kinds / w < 0.4),
            np.minimum((letters + counts["symbol"]) / w, 20) / 10, repeated,
        ],
        axis=1,
    )
    return f, np.maximum(n, 1), per_text


def with_neighbours(f: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A constant, the line's features, and those of the lines before and after (zero outside)."""
    n = len(f)
    first = np.cumsum(per_text) - per_text
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first] = 0
    after[first + per_text - 1] = 0
    return np.concatenate([np.ones((n, 1)), f, before, after], axis=1)


@dataclass
class Chains:
    """Chains laid one after another; steps[t] has the place of each chain's line t."""

    per_text: np.ndarray

    def __post_init__(self):
        order = np.argsort(-self.per_text, kind="stable")
        first = (np.cumsum(self.per_text) - self.per_text)[order]
        live = np.searchsorted(-self.per_text[order], -np.arange(1, (self.per_text.max() if len(order) else 0) + 1), side="right")
        self.steps = [first[:m] + t for t, m in enumerate(live)]

    def messages(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds (good against bad) that arrive from the left, with the line's own, and from the right."""
        a, b = e.copy(), np.zeros_like(e)
        for old, now in zip(self.steps, self.steps[1:], strict=False):
            x = a[old[: len(now)]]
            a[now] += np.logaddexp(t[1, 1] + x, t[0, 1]) - np.logaddexp(t[1, 0] + x, t[0, 0])
        for now, then in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            x = e[then] + b[then]
            b[now[: len(then)]] = np.logaddexp(t[1, 1] + x, t[1, 0]) - np.logaddexp(t[0, 1] + x, t[0, 0])
        return a, b

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.steps) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[: len(y)] for x, y in zip(self.steps, self.steps[1:], strict=False)]), np.concatenate(self.steps[1:])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        f, lengths, per_text = line_features(texts)
        a, b = Chains(per_text).messages(self.emissions(with_neighbours(f, per_text)), self.transitions)
        p = sigmoid(a + b)
        first = np.cumsum(per_text) - per_text
        return np.clip(np.add.reduceat(p * lengths, first) / np.add.reduceat(lengths, first), 0, 1)


def untrained() -> Model:
    m = 1 + 3 * OWN
    return Model(np.zeros(m), np.zeros((2, 2)), np.zeros(m), np.ones(m))


def fit(f: np.ndarray, per_text: np.ndarray, labels: np.ndarray, rounds: int = 250, penalty: float = 1e-3) -> Model:
    """Maximum conditional likelihood with an L2 penalty, by Adam over the whole sample."""
    if not len(labels) or len(np.unique(labels)) < 2:
        return untrained()
    x = with_neighbours(f, per_text)
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    y = np.repeat(labels.astype(np.float64), per_text)
    # Each class weighs the same, and each document no more than a few lines.
    weight = np.repeat(1 / (2 * np.bincount(labels, minlength=2)[labels]) / np.maximum(1, per_text / 4), per_text)
    chains = Chains(per_text)
    left, right = chains.pairs()
    theta, t = np.zeros(z.shape[1]), np.zeros((2, 2))
    moments = [np.zeros(z.shape[1] + 4), np.zeros(z.shape[1] + 4)]
    for step in range(1, rounds + 1):
        e = z @ theta
        a, b = chains.messages(e, t)
        grad = z.T @ (weight * (y - sigmoid(a + b))) - penalty * theta
        pull = np.zeros((2, 2))
        if len(left):
            # Pair marginals from the messages on either side of the edge.
            to = e[right] + b[right]
            log = np.stack([np.full(len(left), t[0, 0]), t[0, 1] + to, t[1, 0] + a[left], t[1, 1] + a[left] + to])
            p = np.exp(log - np.logaddexp.reduce(log, axis=0))
            seen = np.bincount((2 * y[left] + y[right]).astype(int), weight[left], 4)
            pull = (seen - p @ weight[left]).reshape(2, 2)
        pull -= 10 * penalty * t
        g = np.concatenate([grad, pull.ravel()])
        moments = [0.9 * moments[0] + 0.1 * g, 0.99 * moments[1] + 0.01 * g * g]
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        theta += move[:-4]
        t += move[-4:].reshape(2, 2)
    return Model(theta, t, mean, scale)


def spread(lines: np.ndarray) -> np.ndarray:
    """All of a document's lines, or ``LINES`` of them in windows at even distances."""
    if len(lines) <= LINES:
        return lines
    starts = np.linspace(0, len(lines) - WINDOW, LINES // WINDOW).astype(np.int64)
    return lines[(starts[:, None] + np.arange(WINDOW)).ravel()]


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, quality, lines, f (their features) of at most ``sample`` documents of each class outside the held-out fold."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(crc_of_id() % folds != held).distinct()
    rank = F.xxhash64("doc_id")
    parts = [known.where(F.col("quality") == c).orderBy(rank, "doc_id").limit(sample) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.int64()), ("f", pa.binary())])

    def run(batches):
        for batch in pieces(batches, 4 << 20):
            f, _, per_text = line_features(texts_of(batch))
            f = f.astype("<f4")
            own = [spread(f[b - m : b]) for b, m in zip(np.cumsum(per_text), per_text, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], schema=schema)

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    # The sample's ids are bounded by the parameter, so they may be broadcast.  A repeated id counts once, by its least text.
    texts = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(run, "doc_id long, quality int, lines long, f binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = sorted(sampled(docs, labels, sample).collect(), key=lambda r: (r["doc_id"], r["quality"], bytes(r["f"])))
    f = np.frombuffer(b"".join(bytes(r["f"]) for r in rows), "<f4").reshape(-1, OWN).astype(np.float64)
    return fit(f, np.array([r["lines"] for r in rows], np.int64), np.array([r["quality"] for r in rows], np.int64))


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "crf_score") -> DataFrame:
    """The columns of ``docs`` and the score, from the text alone."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = [c for c in docs.columns if c != score]
    out = StructType([*[docs.schema[c] for c in kept], StructField(score, DoubleType())])

    def run(batches):
        for batch in pieces(batches, 4 << 20):
            scores = model.score(texts_of(batch, text))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores)], names=[*kept, score])

    return docs.select(*kept).mapInArrow(run, out)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, sample)
    scored = with_scores(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), model)
    return scored.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), F.col("crf_score").alias("score"), (F.col("crf_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is ``least`` or more."""
    model = train(docs, labels, sample)
    name = "crf_score"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, model, score=name).where(F.col(name) >= least).select(*docs.columns)

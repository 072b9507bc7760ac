"""Toxicity by weak supervision: voters, a generative label model over them, a linear classifier.

Rows in: doc_id and text, further columns ignored. A null text counts as empty and gets the score of a
text on which no voter fires. Every row is scored by itself.
Labels (doc_id, toxic) teach only through rows whose crc32(doc_id as text) mod 4 is not HELD_OUT; a
document with contradictory labels, and null labels, teach nothing. At most `max_labelled` labelled
rows are used, those of least hash of doc_id. Neither labels nor doc_id enter a score.

* Voters: words, and word beginnings of 4 to 6 letters followed by more, whose share of toxic among the
  labelled rows they fire on is above one half with confidence (Wilson bound), at most MAX_VOTERS;
  and two patterns, runs of exclamation marks and mostly capital letters.
* Label model: the true label is hidden. Voters that correlate within the classes by LINKED or more are linked, the
  strongest links first and never in a circle, so every voter has one other at most that it depends on. EM
  estimates how often each voter fires on toxic and on other texts, given the label alone or the label and the vote it depends on, and the
  posterior of every text. No voter speaks for "not toxic": silence of a voter is evidence for it.
* Classifier: logistic regression on which voters fire, fitted to the posteriors.

Without labelled rows of both kinds nothing can be learned: every score is then 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from colloquy.llm.common import staged

HELD_OUT, THRESHOLD = 2, 0.3
MAX_LABELLED, MAX_VOTERS, LEAST_FIRED, Z, LINKED = 20_000, 512, 4, 2.0, 0.1
PATTERNS = ("!!", "CAPITALS")
_WORD = re.compile(r"[^\W_]+")
_BANGS = re.compile(r"!\s*!")
BEGINNINGS = (4, 5, 6)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def signals(text: str) -> set[str]:
    """Every voter's name that could fire on a text."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    out.update(_patterns(text))
    return out


def _patterns(text: str) -> list[str]:
    out = ["!!"] if _BANGS.search(text) else []
    upper = sum(map(str.isupper, text))
    if upper and 2 * upper > upper + sum(map(str.islower, text)):
        out.append("CAPITALS")
    return out


@dataclass
class Scorer:
    """Voters with the weights of the linear classifier."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf
    #: of the label model, for inspection: voter, the one it depends on, P(fires | toxic), P(fires | other), and the prior
    voters: list[tuple[str, str | None, float, float]] = field(default_factory=list)
    prior: float = 0.0

    def fired(self, text: str) -> list[str]:
        words = set(_WORD.findall(text.lower()))
        out = [w for w in words & self.words]
        for n, names in self.beginnings.items():
            hit = {w[:n] for w in words if len(w) > n} & names
            out += [h + "*" for h in hit]
        return sorted(out) + [p for p in _patterns(text) if p in self.weights]

    def prepare(self) -> Scorer:
        self.words = {w for w in self.weights if not w.endswith("*") and w not in PATTERNS}
        self.beginnings = {n: {w[:-1] for w in self.weights if w.endswith("*") and len(w) == n + 1} for n in BEGINNINGS}
        return self

    def score(self, text: str) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in self.fired(text))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _wilson(toxic: int, other: int) -> float:
    n = toxic + other
    p = toxic / n
    return (p + Z * Z / 2 / n - Z * math.sqrt(p * (1 - p) / n + Z * Z / 4 / n / n)) / (1 + Z * Z / n)


def _count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        toxic, other = Counter(), Counter()
        for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
            (toxic if label.as_py() else other).update(signals(text.as_py() or ""))
        names = list(toxic | other)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([other[x] for x in names], pa.int64())], ["signal", "toxic", "other"])


def _votes(voters: list[str]):
    """A row for each batch: the votes on its texts as bits."""
    place = {v: i for i, v in enumerate(voters)}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            votes = np.zeros((batch.num_rows, len(voters)), dtype=np.uint8)
            for row, t in zip(votes, batch.column("text"), strict=True):
                row[[place[s] for s in signals(t.as_py() or "") & place.keys()]] = 1
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([np.packbits(votes).tobytes()], pa.binary())], ["n", "bits"])

    return run


#: Rows of votes that are numbers at once: elsewhere a vote is one byte, so the driver's memory is about that of the votes.
BLOCK = 1024


def _blocks(votes: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """Slices of rows with the votes there, and the rows of more, as doubles."""
    for at in range(0, len(votes), BLOCK):
        rows = slice(at, at + BLOCK)
        yield rows, *[x[rows].astype(np.float64) for x in (votes, *more)]


def _sums(weights: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """weights (classes x rows) times votes."""
    return sum((weights[:, rows] @ v for rows, v in _blocks(votes)), np.zeros((len(weights), votes.shape[1])))


def dependences(votes: np.ndarray, belief: np.ndarray, least: float = LINKED) -> np.ndarray:
    """For each voter the one it depends on (-1: none): a spanning forest of greatest correlations within the classes."""
    # the classes' weights of a row add up to one
    total = sum((v.T @ v for _, v in _blocks(votes)), np.zeros((votes.shape[1],) * 2))
    weights = np.stack([belief, 1 - belief])
    for w, fires in zip(weights, _sums(weights, votes), strict=True):
        total -= np.outer(fires, fires) / max(w.sum(), 1e-9)
    spread = np.sqrt(np.maximum(np.diag(total), 1e-12))
    near = np.abs(total / np.outer(spread, spread))
    n = len(near)
    parent, best, joined = np.full(n, -1), np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(n):
        # the voter most correlated with those in the forest, else the first that is left
        i = int(np.where(joined, -1.0, best).argmax())
        joined[i] = True
        if best[i] < least:
            parent[i] = -1
        closer = near[i] > best
        best[closer & ~joined], parent[closer & ~joined] = near[i][closer & ~joined], i
    return parent


def label_model(votes: np.ndarray, belief: np.ndarray, prior: float, rounds: int = 30, links: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """What each voter depends on, firing rates on toxic and on other texts, the prior and the posteriors, by EM.
    belief starts it: the share of toxic among labelled rows with the same voters. What depends on what is found
    `links` times, the second time from the posteriors of the first EM: the starting belief shows links that are not there."""
    votes = np.asarray(votes, dtype=np.uint8)
    for _ in range(links - 1):
        belief = label_model(votes, belief, prior, rounds, 1)[4]
    parent = dependences(votes, belief)
    given = votes[:, np.maximum(parent, 0)]
    given[:, parent < 0] = 0
    both = votes * given
    for _ in range(rounds):
        rates, tables = [], []
        weights = np.stack([belief, 1 - belief])
        for fires, met, beside, total, extra in zip(*[_sums(weights, x) for x in (votes, given, both)], weights.sum(axis=1), (1.0, 20.0), strict=True):
            rate = (fires + 0.1) / (total + extra)
            # rates given that the other fires or not, drawn towards the voter's own by five texts
            alone = (fires - beside + 5 * rate) / (total - met + 5)
            beside = (beside + 5 * rate) / (met + 5)
            rates.append(rate)
            tables.append((np.clip(beside, 1e-6, 1 - 1e-6), np.clip(alone, 1e-6, 1 - 1e-6)))
        prior = float(np.clip(belief.mean(), 1e-3, 0.5))
        (b1, a1), (b0, a0) = tables
        l11, l10, l01, l00 = np.log(b1 / b0), np.log(a1 / a0), np.log((1 - b1) / (1 - b0)), np.log((1 - a1) / (1 - a0))
        told = [b @ (l11 - l10 - l01 + l00) + v @ (l10 - l00) + g @ (l01 - l00) for _, v, g, b in _blocks(votes, given, both)]
        z = math.log(prior / (1 - prior)) + np.concatenate(told) + l00.sum()
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        done = np.abs(new - belief).max() < 1e-6
        belief = new
        if done:
            break
    return parent, rates[0], rates[1], prior, belief


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the bias, by Newton's method on soft labels."""
    n = x.shape[1] + 1
    w, keep = np.zeros(n), np.full(n, ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        bend, slope = np.diag(keep), keep * w
        for rows, v in _blocks(x):
            v = np.c_[v, np.ones(len(v))]
            p = 1 / (1 + np.exp(-np.clip(v @ w, -50, 50)))
            bend += (v * (p * (1 - p))[:, None]).T @ v
            slope += v.T @ (p - y[rows])
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Scorer:
    """Learn from the labelled rows of the training folds. The driver gets at most MAX_VOTERS counts and,
    for each of at most max_labelled rows, the voters that fire."""
    told = labels.where("toxic is not null and doc_id is not null").where(remainder(F.col("doc_id")) != HELD_OUT)
    told = told.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    # max_labelled ids at most, so they may be broadcast
    sample = told.select("doc_id", "toxic").join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = staged(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(staged(sample, "sample")), "doc_id").select("text", (F.col("toxic") != 0).alias("toxic")), "known")
    size, toxic = known.agg(F.count("*"), F.count_if("toxic")).first()
    if not toxic or toxic == size:
        return Scorer().prepare()
    seen = known.mapInArrow(_count, "signal string, toxic long, other long").groupBy("signal").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    base = toxic / size
    # Wilson's bound is monotone in neither count alone: a plain share first, the bound on what is left
    likely = seen.where((F.col("toxic") >= LEAST_FIRED) & (F.col("toxic") > F.col("other"))).orderBy(F.desc(F.col("toxic") - F.col("other")), "signal").limit(4 * MAX_VOTERS).collect()
    rated = sorted(((_wilson(r["toxic"], r["other"]), r["toxic"], r["signal"]) for r in likely), key=lambda r: (-r[0], r[2]))
    voters = [s for bound, _, s in rated if bound > 0.5][: MAX_VOTERS - len(PATTERNS)]
    voters += [p for p in PATTERNS if p not in voters]
    share = {r["signal"]: (r["toxic"] + base) / (r["toxic"] + r["other"] + 1) for r in likely}
    told = known.select("text").mapInArrow(_votes(voters), "n long, bits binary").collect()
    votes = np.concatenate([np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n * len(voters)).reshape(n, -1) for n, bits in told])
    shares = np.array([share.get(v, base) for v in voters])
    most = np.concatenate([(v * shares).max(axis=1) for _, v in _blocks(votes)])
    belief = np.where(votes.any(axis=1), np.clip(most, 0.01, 0.99), 0.01)
    parent, on, off, prior, belief = label_model(votes, belief, base)
    w = logistic(votes, belief)
    told = [(v, voters[p] if p >= 0 else None, float(a), float(b)) for v, p, a, b in zip(voters, parent.tolist(), on, off, strict=True)]
    return Scorer({v: float(x) for v, x in zip(voters, w, strict=False)}, float(w[-1]), told, prior).prepare()


def _score(scorer: Scorer):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            scores = [scorer.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(scorer), "doc_id long, text string, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs whose score is below THRESHOLD, with all their columns."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    packed = docs.select(row, docs["text"].cast("string").alias("text"))
    schema = StructType([*packed.schema.fields, StructField("score", DoubleType())])
    return packed.mapInArrow(_score(scorer), schema).where(F.col("score") < THRESHOLD).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

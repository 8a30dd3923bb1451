"""A quality classifier without hand labels: overlapping heuristics vote, expectation-maximisation
estimates how often each is right, and the posterior labels train a hashed linear scorer.

A labeller says good, bad or nothing about a document. There are at most 3 ** labellers patterns of
votes, whatever the number of documents: they are counted over the whole corpus, and the model (the
share of good documents, and each labeller's votes for good and for bad ones) is fitted to the counts.
The scorer is a logistic model on hashed byte trigrams and hashed bins of the statistics, trained on
a bounded sample with the posteriors as soft labels, and then applied to every whole text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelytics.llm.isolation import block_counts
from duelytics.llm.store import stored
from duelytics.llm.words import Block, blocks, mix, utf8

GOOD, BAD, NOTHING = 1, 0, 2
BUCKETS = 1 << 14
SAMPLE, SEED = 6_000, 5          # most documents the scorer is trained on, by seeded order
ROUNDS, STEPS = 200, 120
KEEP = 0.2                       # least probability of a good document that is kept
PULL = 0.01                      # every vote is thought to happen at least this often


NEVER_GOOD, NEVER_BAD = -1.0, np.inf


class Labeller(NamedTuple):
    """Votes bad above `bad`, good up to `good`, and nothing between them or on short texts. Most
    know one kind of bad text and say nothing about the others."""

    rate: str
    good: float
    bad: float
    words: int = 8


LABELLERS = [
    Labeller("symbols", NEVER_GOOD, 0.15),
    Labeller("repeats", NEVER_GOOD, 0.4),
    Labeller("capitals", NEVER_GOOD, 0.35),
    Labeller("marks", NEVER_GOOD, 0.35),
    Labeller("equal_lines", NEVER_GOOD, 0.3, 50),
    Labeller("common", NEVER_GOOD, 0.85, 50),
    Labeller("digits", NEVER_GOOD, 0.3, 25),
    Labeller("unlike_prose", 0.4, NEVER_BAD),
    Labeller("not_letters", 0.06, 0.2, 25),
]


def rates(counts: dict[str, np.ndarray], lines: np.ndarray) -> dict[str, np.ndarray]:
    words = np.maximum(counts["n_words"], 1).astype(float)
    chars = np.maximum(counts["word_chars"], 1).astype(float)
    out = {
        "symbols": counts["n_symbols"] / words,
        "repeats": counts["n_repeat_words"] / words,
        "capitals": counts["upper"] / chars,
        "marks": counts["marks"] / words,
        "equal_lines": counts["n_dup_lines"] / np.maximum(lines, 1),
        "common": 1 - counts["distinct"] / words,
        "digits": counts["digits"] / chars,
        "not_letters": (counts["n_symbols"] + counts["marks"] + counts["digits"]) / chars,
    }
    worst = [out["symbols"] / 0.15, out["repeats"] / 0.5, out["capitals"] / 0.35, out["marks"] / 0.35,
             np.abs(chars / words - 5.5) / 5]
    return out | {"unlike_prose": np.max(worst, axis=0)}


def votes(found: dict[str, np.ndarray], n_words: np.ndarray) -> np.ndarray:
    """Documents x labellers."""
    out = np.full((len(n_words), len(LABELLERS)), NOTHING)
    for k, (rate, good, bad, least) in enumerate(LABELLERS):
        out[found[rate] <= good, k] = GOOD
        out[found[rate] > bad, k] = BAD
        out[n_words < least, k] = NOTHING
    return out


def pattern_of(cast: np.ndarray) -> np.ndarray:
    return cast @ 3 ** np.arange(cast.shape[1])


def cast_of(pattern: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(labellers) % 3


class LabelModel(NamedTuple):
    good: float                  # share of good documents
    table: np.ndarray            # class x labeller x vote: probabilities

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row of votes."""
        each = np.log(self.table[:, np.arange(cast.shape[1]), cast]).sum(axis=2)      # class x rows
        odds = each[1] - each[0] + np.log(self.good) - np.log1p(-self.good)
        found = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        return np.where((cast == NOTHING).all(axis=1), self.good, found)


def expectation_maximisation(cast: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Fitted to vote patterns and how many documents hold each; documents without a vote don't
    count. At first a vote for bad weighs more than one for good."""
    weight = weight * (cast != NOTHING).any(axis=1)
    balance = (cast == GOOD).sum(axis=1) - 2.0 * (cast == BAD).sum(axis=1)
    posterior = 1 / (1 + np.exp(-balance))
    model = None
    for _ in range(rounds):
        share = np.clip((posterior * weight).sum() / max(weight.sum(), 1e-9), 0.02, 0.98)
        table = np.empty((2, cast.shape[1], 3))
        for c, belief in ((0, 1 - posterior), (1, posterior)):
            for v in range(3):
                table[c, :, v] = ((cast == v) * (belief * weight)[:, None]).sum(axis=0)
        table += PULL * table.sum(axis=2, keepdims=True) + 1e-6
        table /= table.sum(axis=2, keepdims=True)
        model = LabelModel(float(share), table)
        following = model.posterior(cast)
        moved = np.abs(following - posterior).max(initial=0)
        posterior = following
        if moved < 1e-9:
            break
    return model


class Read(NamedTuple):
    """A block's documents: votes, number of words, and hashed features with their document."""

    cast: np.ndarray
    feature: np.ndarray
    owner: np.ndarray
    value: np.ndarray


def read(block: Block) -> Read:
    counts = block_counts(block)
    lines = block.sums(block.data == 10)
    found = rates(counts, lines)
    cast = votes(found, counts["n_words"])
    # Trigrams of each text, the line feed behind it included; each has its share as value.
    data = block.data.astype(np.uint64)
    gram = mix(data[:-2] | data[1:-1] << np.uint64(8) | data[2:] << np.uint64(16)) if len(data) > 2 else data[:0]
    owner = block.text_of(np.arange(len(gram)))
    inside = np.arange(len(gram)) + 3 <= block.starts[owner + 1]
    gram, owner = gram[inside], owner[inside]
    share = 1.0 / np.maximum(np.bincount(owner, minlength=block.n), 1)
    feature, value = (gram % np.uint64(BUCKETS - 4096)).astype(np.int64), share[owner]
    # Bins of the statistics, in buckets of their own.
    bins, of = [], np.arange(block.n)
    for k, name in enumerate(found):
        bin_ = np.minimum(np.log2(1 + 64 * np.maximum(found[name], 0)), 15).astype(np.uint64)
        bins.append((mix(bin_ + np.uint64(1000 * (k + 1))) % np.uint64(4096)).astype(np.int64) + BUCKETS - 4096)
    feature = np.concatenate([feature, *bins])
    owner = np.concatenate([owner, *[of] * len(bins)])
    value = np.concatenate([value, np.full(len(bins) * block.n, 1.0 / len(found))])
    return Read(cast, feature, owner, value)


class Scorer(NamedTuple):
    weight: np.ndarray
    bias: float

    def probability(self, part: Read, documents: int) -> np.ndarray:
        total = np.bincount(part.owner, part.value * self.weight[part.feature], minlength=documents)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def train(feature: np.ndarray, owner: np.ndarray, value: np.ndarray, label: np.ndarray, steps: int = STEPS,
          penalty: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels; step sizes shrink with the gradients seen so far."""
    weight, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    bias, bias_seen = 0.0, 1e-8
    n = max(len(label), 1)
    for _ in range(steps if len(label) else 0):
        total = np.bincount(owner, value * weight[feature], minlength=len(label)) + bias
        error = (1 / (1 + np.exp(-np.clip(total, -500, 500))) - label) / n
        gradient = np.bincount(feature, value * error[owner], minlength=BUCKETS) + penalty / n * weight
        seen += gradient**2
        bias_seen += error.sum() ** 2
        weight -= 2.0 * gradient / np.sqrt(seen)
        bias -= 0.3 * error.sum() / np.sqrt(bias_seen)
    return Scorer(weight, float(bias))


def vote_patterns(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the pattern of votes on every text."""

    def work(batches):
        for batch in batches:
            found = []
            for block in blocks(utf8(t.as_py() for t in batch.column("text"))):
                counts = block_counts(block)
                found.append(pattern_of(votes(rates(counts, block.sums(block.data == 10)), counts["n_words"])))
            pattern = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(pattern, pa.int64())],
                names=["doc_id", "text_hash", "pattern"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text", "xxhash64(text) AS text_hash").mapInArrow(
        work, "doc_id long, text_hash long, pattern long")


def _sample_features(docs: DataFrame) -> DataFrame:
    """pattern, and the features of a text as bytes: 32-bit numbers and their 32-bit values."""

    def work(batches):
        for batch in batches:
            at = 0
            for block in blocks(utf8(t.as_py() for t in batch.column("text"))):
                part = read(block)
                for k in range(block.n):
                    own = part.owner == k if block.n > 1 else slice(None)
                    feature, inverse = np.unique(part.feature[own], return_inverse=True)
                    value = np.bincount(inverse, part.value[own])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("pattern")[at : at + 1], pa.array([feature.astype(np.int32).tobytes()], pa.binary()),
                         pa.array([value.astype(np.float32).tobytes()], pa.binary())],
                        names=["pattern", "feature", "value"])
                    at += 1

    return docs.select("pattern", "text").mapInArrow(
        work, "pattern long, feature binary, value binary")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The label model from the votes on all of `docs`, the scorer from at most `sample` of them: of the
    rows that share a doc_id, one with the least text hash."""
    known = stored(vote_patterns(docs), "votes")
    counted = known.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    cast = cast_of(counted["pattern"].to_numpy(np.int64))
    model = expectation_maximisation(cast, counted["n"].to_numpy(float))
    chosen = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("text_hash", "pattern")).alias("least")).orderBy(
        F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    chosen = stored(chosen.select(F.col("doc_id").alias("__id"), "least.text_hash", "least.pattern"), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("text_hash")))
    # Copies of a row are one.
    texts = texts.groupBy("doc_id", "pattern").agg(F.min("text").alias("text"))
    rows = _sample_features(texts).toPandas().sort_values(["pattern", "feature", "value"], kind="stable")
    if not len(rows):
        return model, Scorer(np.zeros(BUCKETS), 0.0)
    feature = [np.frombuffer(x, np.int32) for x in rows["feature"]]
    value = [np.frombuffer(x, np.float32) for x in rows["value"]]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in feature])
    label = model.posterior(cast_of(rows["pattern"].to_numpy(np.int64)))
    return model, train(np.concatenate(feature).astype(np.int64), owner, np.concatenate(value).astype(float), label)


def classify(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, posterior (of the votes), score (the scorer's probability of a good document) and
    kept for every row of `docs`.

    Null and empty texts get no votes, so the share of good documents is their posterior; the scorer
    knows them by their statistics only. Equal rows get equal scores; other columns are not looked at;
    an empty table gives no rows.
    """
    model, scorer = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))     # BUCKETS numbers

    def work(batches):
        model, scorer = shared.value
        for batch in batches:
            posterior, score = [], []
            for block in blocks(utf8(t.as_py() for t in batch.column("text"))):
                part = read(block)
                posterior.append(model.posterior(part.cast))
                score.append(scorer.probability(part, block.n))
            joined = [np.concatenate(x) if x else np.zeros(0) for x in (posterior, score)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, joined), pa.array(joined[1] >= keep)],
                names=["doc_id", "posterior", "score", "kept"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(
        work, "doc_id long, posterior double, score double, kept boolean")

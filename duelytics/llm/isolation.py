"""Quality rules: an isolation forest on rule statistics, calibrated on labelled documents.

The statistics of a text are plain counts. The forest is grown on a bounded sample of labelled
clean documents, by random splits of random statistics; a document that falls out of the
sample's range is separated by few splits. The verdict's threshold is a quantile of the path
lengths of other labelled clean documents, so that the share of clean documents which fail is a
parameter and not an accident.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelytics.llm.words import Block, blocks, mix, plain_words, utf8, windows

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50          # the base rules
LABELLED = 20_000                         # most labelled rows used, by seeded order
TREES, SUBSAMPLE, SEED = 200, 256, 7
CLEAN_LOSS = 0.002                        # share of held-out clean rows that may fail

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SHAPES = ["upper", "marks", "digits", "distinct"]

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_upper = np.zeros(256, bool)
_upper[list(range(65, 91))] = True
_marks = np.zeros(256, bool)
_marks[list(b"!?=_{}\\/~^@;:\"'()")] = True
_digit = np.zeros(256, bool)
_digit[list(range(48, 58))] = True
_line = np.ones(256, bool)
_line[10] = False


def block_counts(block: Block) -> dict[str, np.ndarray]:
    """The statistics of each text of a block."""
    starts, ends = plain_words(block)
    owner = block.text_of(starts)
    words = block.hashes(starts, ends)
    n_words = np.bincount(owner, minlength=block.n)
    data = block.data
    not_space = np.zeros(len(data) + 1, np.int64)
    np.add.at(not_space, starts, 1)
    np.add.at(not_space, ends, -1)
    inside = np.cumsum(not_space[:-1]).astype(bool)

    # Words in 3-word windows that occur twice or more in their text.
    window, at = windows(words, owner, 3)
    repeated = np.zeros(len(words), bool)
    if len(window):
        key = window ^ mix(owner[at].astype(np.uint64) + np.uint64(1))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[inverse] > 1]
        for k in range(3):
            repeated[twice + k] = True

    # Lines with a word, equal to an earlier one of their text.
    line_starts, line_ends = block.runs(_line)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_owner = block.text_of(line_starts)
    key = block.hashes(line_starts, line_ends) ^ mix(line_owner.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(line_owner, minlength=block.n)
    distinct_lines = np.bincount(line_owner[first], minlength=block.n)

    distinct = np.unique(words ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    return {
        "n_words": n_words,
        "word_chars": block.sums(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": block.sums(_symbol[data]),
        "n_dup_lines": lines - distinct_lines,
        "n_repeat_words": np.bincount(owner[repeated], minlength=block.n),
        "upper": block.sums(_upper[data]),
        "marks": block.sums(_marks[data]),
        "digits": block.sums(_digit[data]),
        "distinct": np.bincount(owner[distinct], minlength=block.n),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text."""

    def work(batches):
        for batch in batches:
            parts = [block_counts(b) for b in blocks(utf8(t.as_py() for t in batch.column("text")))]
            columns = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
                       for c in COUNTS + _SHAPES]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", *COUNTS, *_SHAPES])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS + _SHAPES)])
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(work, schema)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The rates the forest looks at; none depends on how long a clean text is."""
    words = np.maximum(counts["n_words"], 1).astype(float)
    chars = np.maximum(counts["word_chars"], 1).astype(float)
    return np.stack([
        chars / words,
        counts["n_symbols"] / words,
        counts["n_dup_lines"] / words,
        counts["n_repeat_words"] / words,
        counts["upper"] / chars,
        counts["marks"] / words,
        counts["digits"] / chars,
    ], axis=1)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest(NamedTuple):
    """Trees as arrays; a leaf has feature -1 and its path length in `value`."""

    feature: np.ndarray     # trees x nodes
    value: np.ndarray
    left: np.ndarray        # the right child follows the left one
    threshold: float        # the least mean path length that passes

    def path_lengths(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        for feature, value, left in zip(self.feature, self.value, self.left):
            node = np.zeros(len(points), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = points[np.arange(len(points)), np.maximum(f, 0)] >= value[node]
                node = np.where(inner, left[node] + right, node)
            total += value[node]
        return total / len(self.feature)

    def keeps(self, points: np.ndarray) -> np.ndarray:
        return self.path_lengths(points) >= self.threshold


def grow(points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """A split value is drawn between the bounds of the node's region, which at the root reach
    beyond the sample, so that points outside its range are cut off early."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(points))
    limit = int(np.ceil(np.log2(max(size, 2)))) + 4
    spread = points.max(axis=0) - points.min(axis=0)
    reach = np.maximum(spread, 0.05)
    nodes = 4 * size + 3
    feature = np.full((trees, nodes), -1)
    value, left = np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int64)
    for t in range(trees):
        sample = points[rng.choice(len(points), size, replace=False)]
        used = 1
        todo = [(0, sample, points.min(axis=0) - reach, points.max(axis=0) + reach, 0)]
        while todo:
            node, inside, low, high, depth = todo.pop()
            if depth >= limit or len(inside) <= 1 or used + 2 > nodes:
                value[t, node] = depth + _mean_path(len(inside))
                continue
            f = rng.integers(points.shape[1])
            at = rng.uniform(low[f], high[f])
            right = inside[:, f] >= at
            feature[t, node], value[t, node], left[t, node] = f, at, used
            upper, lower = high.copy(), low.copy()
            upper[f], lower[f] = at, at
            todo.append((used, inside[~right], low, upper, depth + 1))
            todo.append((used + 1, inside[right], lower, high, depth + 1))
            used += 2
    return Forest(feature, value, left, -np.inf)


def fit(labelled: dict[str, np.ndarray], quality: np.ndarray, clean_loss: float = CLEAN_LOSS) -> Forest | None:
    """Half of the clean rows grow the forest, the other half set the threshold. Without clean rows
    there is nothing to compare with, and only the base rules hold."""
    usable = (quality == 1) & ~base_failed(labelled)
    points = features(labelled)[usable]
    if len(points) < 2:
        return None
    forest = grow(points[::2])
    held_out = np.sort(forest.path_lengths(points[1::2]))
    allowed = int(clean_loss * len(held_out))
    margin = 0.02 * np.median(held_out)
    return forest._replace(threshold=float(held_out[allowed] - margin))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """doc_id, text, quality of the rows of at most `rows` labelled documents, chosen by a seeded order of
    their ids, whichever of them `docs` still holds. The bound makes the broadcast safe."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").alias("__quality"))
        .orderBy(F.xxhash64("__id", F.lit(SEED)), "__id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(
        "doc_id", "text", F.col("__quality").cast("int").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> Forest | None:
    """Statistics of a bounded sample come to the driver: a few numbers for each of `rows` ids. Of rows that
    share a labelled id, the one with the least statistics counts."""
    sample = labelled_sample(docs, labels, rows)
    known = sample.select(F.col("doc_id").alias("known"), "quality").distinct()
    least = statistics(sample).groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *_SHAPES)).alias("least"))
    counted = (
        least.join(known, F.col("doc_id") == F.col("known")).select("doc_id", "quality", "least.*")
        .orderBy("doc_id").toPandas()
    )
    counts = {c: counted[c].to_numpy(np.int64) for c in COUNTS + _SHAPES}
    return fit(counts, counted["quality"].to_numpy(int))


def _judged(counts: dict[str, np.ndarray], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """base_failed, kept and the mean path length of each text."""
    failed = base_failed(counts)
    length = None if forest is None else forest.path_lengths(features(counts))
    return failed, ~failed if forest is None else ~failed & (length >= forest.threshold), length


def rule_verdicts(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the mean path length for every row of `docs`.

    Null and empty texts have no words and fail the base rules. Equal rows get equal verdicts, an
    empty table gives no rows. Without labels only the base rules decide (path_length is null). Labels
    that repeat an id count with their larger quality. Other columns are not looked at.
    """
    forest = train(docs, labels, rows)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(forest)  # TREES x 4 SUBSAMPLE nodes

    def work(batches):
        forest = shared.value
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in COUNTS + _SHAPES}
            failed, kept, length = _judged(counts, forest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in COUNTS), pa.array(failed),
                 pa.array(kept),
                 pa.nulls(len(failed), pa.float64()) if length is None else pa.array(length)],
                names=["doc_id", *COUNTS, "base_failed", "kept", "path_length"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean",
                        "path_length double"])
    return statistics(docs).mapInArrow(work, schema)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose own verdict is to keep them, with all their columns. The verdict hangs on
    the text alone, so a row without an id and rows that share an id are judged each by itself; no row moves."""
    forest = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES x 4 SUBSAMPLE nodes

    def work(batches):
        forest = shared.value
        for batch in batches:
            kept = [_judged(block_counts(b), forest)[1] for b in blocks(utf8(t.as_py() for t in batch.column("text")))]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(work, docs.schema)

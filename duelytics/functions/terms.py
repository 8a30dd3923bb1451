"""Words and pairs of neighbouring words of long texts, counted only where they can be in a vocabulary.

Most pairs of words occur a few times, and there are about as many of them as words in the texts.  A first
pass counts the 64-bit hashes of all terms by model, so that what the vocabulary's limits rule out (terms in too few
or too many models, and all but the most frequent of the rest) is known without a string.  A second pass counts
exactly, as strings, the terms whose hashes fall into the buckets of those that are left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelytics.functions.text import WORD

BUCKET_BITS = 22
BUCKETS = 1 << BUCKET_BITS
CHUNK, HELD = 1 << 18, 500_000  # bytes of text looked at together, terms held by a task
HASHES, PART = 1 << 23, 6 << 20  # hashes held by a task, bytes of stored texts for each part of the hashes
STEP, UNSTEP = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
FIRST, SECOND, MIX = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))


def spaced(docs: DataFrame) -> DataFrame:
    """model, text: everything that is no word character is one space, as bytes."""
    text = F.regexp_replace("text", F.lit(WORD.replace("[", "[^", 1) + "+"), F.lit(" "))
    return docs.select("model", text.cast("binary").alias("text")).filter(F.col("text").isNotNull())


def _chunks(texts: Iterator[bytes]) -> Iterator[bytes]:
    """Texts joined by line breaks (which `spaced` leaves in none)."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


class Hashes:
    """The words of two characters or more of a chunk, and the hashes of them and of their pairs."""

    def __init__(self):
        self.powers = self.inverse = np.ones(0, np.uint64)

    def __call__(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends, hash of each word; first word and hash of each pair inside one text."""
        data = np.frombuffer(chunk, np.uint8)
        if len(self.powers) <= len(data):
            n = 2 * len(data) + 1
            self.powers, self.inverse = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
                for x in (STEP, UNSTEP)
            )
        apart = np.concatenate([[True], data <= 32, [True]])
        edges = np.flatnonzero(apart[1:] != apart[:-1])
        starts, ends = edges[::2], edges[1::2]
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        words = heads[ends] - heads[starts] > 1
        starts, ends = starts[words], ends[words]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        own = (sums[ends] - sums[starts]) * self.inverse[starts]
        text = np.cumsum(data == 10)[starts]
        first = np.flatnonzero(text[1:] == text[:-1])
        return starts, ends, mixed(own), first, mixed(own[first] * FIRST + own[first + 1] * SECOND)


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes * MIX
    hashes ^= hashes >> np.uint64(32)
    return hashes * MIX


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, in columns of one row or more."""
    return np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)]))


def hash_counts(texts: DataFrame, part_bits: int) -> DataFrame:
    """part, models, lengths, hash, n: how often a task met the hashes of the terms of `spaced` texts.

    A row holds the hashes of a part (those that begin with its bits), packed, and how often each occurred: those of
    the first model, as many as the first length, then those of the next.  A task counts `HASHES` terms at a time.
    """

    def work(batches):
        hashes = Hashes()
        held: dict[str | None, list[np.ndarray]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            models, keys, counts = list(held), [], []
            for model in models:
                own = np.concatenate(held.pop(model))
                own.sort()
                starts = runs(own)
                keys.append(own[starts])
                counts.append(np.diff(starts, append=len(own)).astype("<i4"))
            codes = np.repeat(np.arange(len(models)), [len(x) for x in keys])
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            parts = (keys >> np.uint64(64 - part_bits)).astype(np.uint16)
            order = np.argsort(parts, kind="stable")
            parts, codes = parts[order], codes[order]
            rows, lists = runs(parts), runs(parts, codes)

            def packed(values: np.ndarray) -> pa.Array:
                offsets = (np.append(rows, len(values)) * values.itemsize).astype(np.int32)
                return pa.Array.from_buffers(
                    pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(values[order])])

            def listed(values: pa.Array) -> pa.Array:
                offsets = np.append(np.searchsorted(lists, rows), len(lists)).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), values)

            batch = pa.RecordBatch.from_pydict({
                "part": pa.array(parts[rows], pa.int32()),
                "models": listed(pa.array(models, pa.string()).take(pa.array(codes[lists]))),
                "lengths": listed(pa.array(np.diff(lists, append=len(codes)), pa.int32())),
                "hash": packed(keys.astype("<u8", copy=False)), "n": packed(counts),
            })
            step = -(-batch.num_rows // 16)  # the JVM holds one of these at a time
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)

        size = 0
        for batch in batches:
            by_model: dict[str | None, list[int]] = {}
            for i, model in enumerate(batch.column("model").to_pylist()):
                by_model.setdefault(model, []).append(i)
            column = batch.column("text")
            for model, rows in by_model.items():
                for chunk in _chunks(column[i].as_py() for i in rows):
                    _, _, words, _, pairs = hashes(chunk)
                    if len(words):
                        held.setdefault(model, []).extend((words, pairs))
                    size += len(words) + len(pairs)
                    if size > HASHES:
                        yield from handed_on()
                        size = 0
        if size:
            yield from handed_on()

    return texts.mapInArrow(work, "part int, models array<string>, lengths array<int>, hash binary, n binary")


def fitting_buckets(texts: DataFrame, n: int, min_df: int, max_df: float) -> DataFrame:
    """bucket, total: one row for each hash that between `min_df` and `max_df` models have, if it is among the `n`
    most frequent of its part or as frequent as the last of them.

    Parts are as many as the texts are large, so a task sorts a bounded number of hashes.  Two terms that share
    64 bits count as one here: a term of the vocabulary can only be missed if it shares them with another one, of
    which the odds are about 10,000 x 10^9 / 2^64 for a vocabulary of 10,000 and 10^9 different terms.
    """
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    part_bits = min(16, max(4, (size // PART).bit_length()))

    def work(table: pa.Table) -> pa.Table:
        rows = table.select(["models", "lengths", "hash", "n"]).to_pylist()
        place: dict[str | None, int] = {}
        models = np.concatenate([
            np.repeat([place.setdefault(m, len(place)) for m in row["models"]], row["lengths"]) for row in rows])
        hashes = np.concatenate([np.frombuffer(row["hash"], "<u8") for row in rows])
        counts = np.concatenate([np.frombuffer(row["n"], "<i4") for row in rows]).astype(np.int64)
        order = np.lexsort((models, hashes))
        models, hashes, counts = models[order], hashes[order], counts[order]
        starts = runs(hashes)
        totals = np.add.reduceat(counts, starts)
        pairs = runs(hashes, models)
        df = np.diff(np.searchsorted(pairs, starts), append=len(pairs))
        fit = (df >= min_df) & (df <= max_df)
        totals, buckets = totals[fit], bucket(hashes[starts[fit]])
        if len(totals) > n:
            reach = totals >= np.partition(totals, len(totals) - n)[len(totals) - n]
            totals, buckets = totals[reach], buckets[reach]
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "total": pa.array(totals, pa.int64())})

    return hash_counts(texts, part_bits).groupBy("part").applyInArrow(work, "bucket int, total long")


def counts_in_buckets(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """(model, term, tf) of the terms of `spaced` texts that fall into `buckets`; a map of `BUCKETS` bits travels
    with the tasks."""
    words = buckets.selectExpr("bucket div 64 AS word", "bucket % 64 AS bit").groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits"))
    bits = np.zeros(BUCKETS // 64, np.int64)
    for row in words.collect():  # at most BUCKETS / 64 rows
        bits[row["word"]] = row["bits"]
    kept = bits.astype("<i8").tobytes()

    def work(batches):
        hashes = Hashes()
        among = np.unpackbits(np.frombuffer(kept, np.uint8), bitorder="little").astype(bool)
        held: dict[str | None, Counter] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for model, counted in held.items():
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array([model] * len(counted), pa.string()),
                    "term": pa.array(list(counted), pa.binary()).cast(pa.string()),
                    "tf": pa.array(list(counted.values()), pa.int64()),
                })
            held.clear()

        for batch in batches:
            by_model: dict[str | None, list[int]] = {}
            for i, model in enumerate(batch.column("model").to_pylist()):
                by_model.setdefault(model, []).append(i)
            column = batch.column("text")
            for model, rows in by_model.items():
                for chunk in _chunks(column[i].as_py() for i in rows):
                    starts, ends, words, first, pairs = hashes(chunk)
                    words, pairs = bucket(words), bucket(pairs)
                    counted = held.setdefault(model, Counter())
                    on = among[words]
                    counted.update(
                        [chunk[a:b] for a, b in zip(starts[on].tolist(), ends[on].tolist())])
                    first = first[among[pairs]]
                    sides = [x[i].tolist() for i in (first, first + 1) for x in (starts, ends)]
                    counted.update([
                        chunk[a:d] if b + 1 == c else chunk[a:b] + b" " + chunk[c:d]  # a letter between is no word
                        for a, b, c, d in zip(*sides)])
                    if sum(map(len, held.values())) > HELD:
                        yield from handed_on()
        yield from handed_on()

    parts = texts.mapInArrow(work, "model string, term string, tf long")
    return parts.groupBy("model", "term").agg(F.sum("tf").alias("tf"))

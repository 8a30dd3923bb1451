"""Near-duplicate texts by SimHash fingerprints that are compared at the anchors of a covering code.

A covering code has a codeword within its radius R of every word. Between two words that differ in at most
t bits lies a word that differs from each in at most t / 2 (rounded up), and the codeword next to
that one is within R + t / 2 of both. So every word is sent to all codewords within R + t / 2 and compared
there with all others: no close pair is lost.

The 64 bits are cut into three blocks, each covered by the perfect binary Golay code of length 23 and
radius 3 (shorter blocks are filled up with zeros). Of two fingerprints that differ in at most d bits
two blocks differ together in at most t = 2 d / 3. An anchor is a codeword in each of two blocks; for d = 4 a
fingerprint goes to about 10 anchors of each of the three pairs of blocks, whatever the corpus.

Fingerprints that share the nearest anchor of the first pair are compared first. After that only links
between different components count, and an anchor hands on a spanning forest of them, never all pairs.
An anchor with many fingerprints is cut into blocks, and pairs of blocks are compared in tasks of
bounded size.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelytics.llm.graph import components
from duelytics.llm.store import stored

WIDTH, DISTANCE, SEED = 4, 4, 42
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b110001110101  # of the Golay code
SHIFTS, BITS = (0, 22, 43), (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
ANCHORS = 1 << 2 * (LENGTH - CHECKS)  # of one pair of blocks
CROWD, CHUNK = 4096, 256
SHINGLES = 1 << 16

_U = np.uint64
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, width: int = WIDTH):
    """Arrays of the XXH64 of each run of `width` words, joined by spaces, in the order of the text; a
    shorter text with a word is one run."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = ends - lengths, ends[min(width, len(words)) - 1:]
    for low in range(0, len(stops), SHINGLES):
        high = min(low + SHINGLES, len(stops))
        yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(
            starts[low:high].tolist(), stops[low:high].tolist())), _U, high - low)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits, each 1 if it is in more than half of the hashes; 0 without a word."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        parts = hashes.view(np.uint8).reshape(-1, 8)
        n += len(hashes)
        if len(hashes) < 256:
            ones += np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            ones += np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS_OF for k in range(8)])
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by the generator of the low 12 bits and of the high 11 bits of a word."""
    rest, value = [], 1
    for _ in range(LENGTH):
        rest.append(value)
        value = value << 1
        value ^= GENERATOR if value >> CHECKS else 0
    tables = []
    for bits in (rest[:12], rest[12:]):
        table = np.zeros(1 << len(bits), np.int32)
        for k, r in enumerate(bits):
            table[np.arange(len(table)) >> k & 1 == 1] ^= r
        tables.append(table)
    return tables[0], tables[1]


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[words & 0xFFF] ^ high[words >> 12]


@cache
def _patterns(further: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences to the codewords at distance RADIUS + further (up to RADIUS, if 0), by syndrome, and
    where each syndrome's begin."""
    weights = range(RADIUS + 1) if further == 0 else [RADIUS + further]
    words = np.array([sum(1 << k for k in ones) for w in weights for ones in combinations(range(LENGTH), w)], np.int64)
    of = syndrome(words)
    order = np.argsort(of, kind="stable")
    return words[order], np.searchsorted(of[order], np.arange((1 << CHECKS) + 1))


def anchors(prints: np.ndarray, further: int, pairs=PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Place of a fingerprint and an anchor it is sent to, for all anchors at most `further` beyond the
    radius."""
    blocks = [(prints >> _U(s) & _U((1 << b) - 1)).astype(np.int64) for s, b in zip(SHIFTS, BITS)]
    of = [syndrome(block) for block in blocks]
    owners, keys = [], []
    for pair, (x, y) in enumerate(pairs):
        for t in range(further + 1):
            for u in range(further + 1 - t):
                (px, ox), (py, oy) = _patterns(t), _patterns(u)
                nx, ny = np.diff(ox)[of[x]], np.diff(oy)[of[y]]
                n = nx * ny
                owner = np.repeat(np.arange(len(prints)), n)
                k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                a = (blocks[x][owner] ^ px[ox[of[x][owner]] + k // ny[owner]]) >> CHECKS
                b = (blocks[y][owner] ^ py[oy[of[y][owner]] + k % ny[owner]]) >> CHECKS
                owners.append(owner)
                keys.append(pair * ANCHORS + (a << (LENGTH - CHECKS)) + b)
    return np.concatenate(owners), np.concatenate(keys)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer."""

    def work(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], _U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))],
                                             names=["doc_id", "print"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(work, "doc_id long, print long")


def _at_anchors(prints: DataFrame, further: int, pairs=PAIRS) -> DataFrame:
    """anchor, print, label."""

    def work(batches):
        for batch in batches:
            whole, names = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("print", "label"))
            for low in range(0, len(whole), 4096):
                own, label = whole[low:low + 4096], names[low:low + 4096]
                owner, key = anchors(own.view(_U), further, pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int32)), pa.array(own[owner]), pa.array(label[owner])],
                    names=["anchor", "print", "label"])

    return prints.select("print", "label").mapInArrow(work, "anchor int, print long, label long")


def forest(x: np.ndarray, x_label: np.ndarray, y: np.ndarray, y_label: np.ndarray, distance: int):
    """Edges between labels that connect what links of at most `distance` bits between `x` and `y` connect."""
    names, place = np.unique(np.concatenate([x_label, y_label]), return_inverse=True)
    roots = np.arange(len(names))
    a, b = [], []
    for low in range(0, len(y), CHUNK):
        linked = np.bitwise_count(x[:, None] ^ y[None, low:low + CHUNK]) <= distance
        own = place[len(x):][low:low + CHUNK]
        while True:  # each root goes to the smallest one it is linked with
            left, right = roots[place[:len(x)]], roots[own]
            i, j = np.nonzero(linked & (left[:, None] != right[None, :]))
            if not len(i):
                break
            high, least = np.maximum(left[i], right[j]), np.minimum(left[i], right[j])
            np.minimum.at(roots, high, least)
            high = np.unique(high)
            a.append(names[high])
            b.append(names[roots[high]])
            while (roots[roots] != roots).any():
                roots = roots[roots]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _dealt(visits: DataFrame, crowd: int) -> DataFrame:
    """anchor, low, high, second, print, label: what meets in a task.

    A visit stands once, whether its anchor has others or not, so that rows grow with the fingerprints; only at
    anchors of more than `crowd` it stands once for every block. Those anchors are at most a `crowd`-th of the visits.
    """
    crowded = visits.groupBy(F.col("anchor").alias("at")).agg(F.ceil(F.count("*") / crowd).alias("n")).where("n > 1")
    met = visits.join(F.broadcast(crowded), F.col("anchor") == F.col("at"), "left").withColumn(
        "blocks", F.coalesce("n", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("print"), "blocks"))
    # A block meets itself and every other one; the first of a pair of blocks has the smaller number.
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(
        F.least(F.col("block"), other).alias("low"), F.greatest(F.col("block"), other).alias("high")))
    return met.select("anchor", "print", "label", "block", F.explode(pairs).alias("q")).select(
        "anchor", "q.low", "q.high", (F.col("block") != F.col("q.low")).alias("second"), "print", "label")


def _compared(visits: DataFrame, distance: int, crowd: int) -> DataFrame:
    """a, b: edges between the labels of fingerprints that meet at an anchor."""
    dealt = _dealt(stored(visits, "visits"), crowd)

    def work(batches):
        rest = [np.zeros(0, np.int64) for _ in range(6)]

        def linked(rows):
            anchor, low, high, second, own, label = rows
            cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(own)]])
            apart = np.logical_or.reduceat(label != np.repeat(label[starts], ends - starts), starts)
            found = []
            for i, j in zip(starts[apart].tolist(), ends[apart].tolist()):
                k = i + np.searchsorted(second[i:j], 1)
                one = slice(i, k)
                other = one if low[i] == high[i] else slice(k, j)
                found.append(forest(own[one].view(_U), label[one], own[other].view(_U), label[other], distance))
            edges = [np.concatenate(side) for side in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
            return pa.RecordBatch.from_arrays([pa.array(e) for e in edges], names=["a", "b"])

        for batch in batches:
            columns = [c.cast(pa.int8()) if c.type == pa.bool_() else c for c in batch.columns]
            rest = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, columns)]
            # The last group may go on in the next batch.
            changes = np.flatnonzero(np.any([np.diff(r) != 0 for r in rest[:3]], axis=0))
            if len(changes):
                cut = changes[-1] + 1
                yield linked([r[:cut] for r in rest])
                rest = [r[cut:] for r in rest]
        if len(rest[0]):
            yield linked(rest)

    return dealt.repartition("anchor", "low", "high").sortWithinPartitions(
        "anchor", "low", "high", "second").mapInArrow(work, "a long, b long").distinct()


def links(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """a, b: edges between distinct fingerprints (column `print`) that connect just those that chains of
    links of at most `distance` differing bits connect."""
    own = prints.select("print", F.col("print").alias("label"))
    first = stored(_compared(_at_anchors(own, 0, PAIRS[:1]), distance, crowd), "first-links")
    near = components(first)
    named = prints.select("print").join(near, F.col("print") == F.col("id"), "left").select(
        "print", F.coalesce("label", "print").alias("label"))
    further = -(-(2 * distance // 3) // 2)
    return first.union(_compared(_at_anchors(named, further), distance, crowd))


def near_copies(docs: DataFrame, distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of `docs`.

    component_id is the smallest doc_id that chains of links reach, the row's own included; two rows
    link if their fingerprints differ in at most `distance` bits. Null and empty texts, and texts
    without a word, have fingerprint zero and link like any other. Rows are what links join: two rows
    that share a doc_id need not meet. A row without a doc_id has its component's smallest one, or null
    if none has any. No rows give no rows. Other columns are not looked at.
    """
    if not 0 <= distance <= 6:
        raise ValueError("a distance from 0 to 6")
    own = stored(fingerprints(docs, width), "fingerprints")
    known = stored(own.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    found = components(stored(links(known, distance), "links"))
    placed = known.join(found, known["print"] == found["id"], "left").select(
        "print", "first", F.coalesce("label", "print").alias("label"))
    firsts = placed.groupBy(F.col("label").alias("name")).agg(F.min("first").alias("component_id"))
    classes = placed.join(firsts, F.col("label") == F.col("name")).select(F.col("print").alias("known"), "component_id")
    return own.join(classes, F.col("print") == F.col("known")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

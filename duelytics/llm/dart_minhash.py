"""Near duplicates by DartMinHash signatures and banded joins.

A text is the set of its five-word shingles, each with a weight (1, or how often it occurs). Every
element has an area of its weight; hashed darts fall on area and time as a Poisson process that
depends on the element alone. A dart names a coordinate; the signature keeps for each coordinate the
earliest dart that hits one of the text's areas. Two texts agree in a coordinate with the probability
of their weighted Jaccard similarity. Only about t ln t darts are needed in all, whatever the number
of elements, instead of t hashes for each element.

Texts with equal sets are one class at once, so copies are signed and compared once. Classes meet in
buckets of `ROWS` coordinates. In a bucket everyone is compared with the smallest id first; what has
then become one component needs no further comparison within itself; everyone outside the leader's
component is compared with all of other components, after a size bound and a sketch of two bits for
each coordinate that a similar pair passes with all but 1e-5 probability. Where a bucket has few such
outsiders, the pairs that pass are written out; where it has many, the bucket's texts meet in blocks
of bounded size and only links are written, so rows grow with a bucket and not with its square. A link
is a verified similarity of the whole sets, classes are connected components. No bucket is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duelytics.llm.graph import components
from duelytics.llm.store import stored
from duelytics.llm.words import Block, alnum_words, blocks, mix, utf8, windows

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
LEAST_AGREEING = 89        # of 125 sketched coordinates; a pair of similarity 0.8 has 106 +- 4
GROUP = 500                # texts compared with one copy of a leader
OUTSIDERS = 16             # a bucket with more of them is compared in blocks ...
BLOCK = 500                # ... of so many outsiders, against parts of so many texts

_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(18)])
_U = np.uint64


def text_shingles(block: Block, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ascending distinct shingle hashes and their counts of each lower-cased text. A text of fewer
    than `width` words is one shingle, one without words none."""
    starts, ends = alnum_words(block)
    owner = block.text_of(starts)
    hashes = block.hashes(starts, ends)
    count = np.bincount(owner, minlength=block.n)
    found, at = windows(hashes, owner, width)
    of = owner[at]
    for k in range(1, width):
        short, at = windows(hashes, owner, k)
        own = owner[at]
        fits = count[own] == k
        if fits.any():
            found, of = np.concatenate([found, short[fits]]), np.concatenate([of, own[fits]])
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(block.n + 1))
    found = found[order]
    return [np.unique(found[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:])]


def dart_signature(elements: np.ndarray, weights: np.ndarray, t: int) -> np.ndarray:
    """For each of `t` coordinates the name of the earliest dart; elements are not empty."""
    strips = np.ceil(weights).astype(np.int64)
    strip_of = np.repeat(np.arange(len(elements)), strips)
    number = np.arange(len(strip_of)) - np.repeat(np.cumsum(strips) - strips, strips)
    area = mix(elements[strip_of] + mix(number.astype(_U)) * _U(3))     # one per unit of weight
    room = np.minimum(weights[strip_of] - number, 1.0)                  # part of it that is inside
    until = t * (np.log(t) + 3) / weights.sum()
    while True:
        cells = int(np.ceil(until))                                     # one dart a cell on average
        cell = np.tile(np.arange(cells), len(area))
        place = np.repeat(np.arange(len(area)), cells)
        seed = mix(area[place] ^ mix(cell.astype(_U) + _U(0xA5A5)))
        darts = np.searchsorted(_CDF, (seed >> _U(11)).astype(float) * 2.0**-53, "right")
        of = np.repeat(np.arange(len(seed)), darts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
        name = mix(seed[of] + (nth.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        fall = mix(name ^ _U(0x5851F42D4C957F2D))
        time = cell[of] + (fall >> _U(11)).astype(float) * 2.0**-53
        where = (mix(name ^ _U(0x14057B7EF767814F)) >> _U(11)).astype(float) * 2.0**-53
        hit = (time < until) & (where < room[place[of]])
        name, time = name[hit], time[hit]
        coordinate = (mix(name) >> _U(33)) % _U(t)
        signature, filled = np.zeros(t, _U), np.zeros(t, bool)
        late_first = np.argsort(-time, kind="stable")
        signature[coordinate[late_first].astype(np.int64)] = name[late_first]
        filled[coordinate.astype(np.int64)] = True
        if filled.all():
            return signature
        until *= 2


class Signed(NamedTuple):
    n: int
    f1: int
    f2: int
    bands: np.ndarray
    sketch: np.ndarray


def signed(elements: np.ndarray, weights: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> Signed:
    """Number of elements, fingerprints of the weighted set, bucket of each band, two bits for each
    coordinate (32 coordinates a word)."""
    signature = dart_signature(elements, weights, bands * rows)
    tagged = mix(elements + mix(weights.astype(np.float64).view(_U)))
    f1, f2 = mix(tagged).sum(dtype=_U), mix(tagged ^ _U(0xD1B54A32D192ED03)).sum(dtype=_U)
    total = mix(np.arange(bands, dtype=_U) + _U(77))
    for column in signature.reshape(bands, rows).T:
        total = mix(total ^ column)
    pairs = np.zeros(-(-len(signature) // 32) * 32, _U)
    pairs[: len(signature)] = mix(signature ^ _U(0xABCDEF)) & _U(3)
    sketch = (pairs.reshape(-1, 32) << (_U(2) * np.arange(32, dtype=_U))).sum(axis=1, dtype=_U)
    return Signed(len(elements), int(f1.view(np.int64)), int(f2.view(np.int64)),
                  total.view(np.int64), sketch.view(np.int64))


def _lowered(batch) -> Iterator[Block]:
    return blocks(text.lower() for text in utf8(t.as_py() for t in batch.column("text")))


def signatures(docs: DataFrame, counted: bool = False) -> DataFrame:
    """doc_id, n, f1, f2, bands, sketch of every text with a word. `counted` weighs shingles by how
    often they occur."""

    def work(batches):
        for batch in batches:
            ids, rows = [], []
            at = 0
            for block in _lowered(batch):
                for elements, counts in text_shingles(block):
                    if len(elements):
                        ids.append(batch.column("doc_id")[at].as_py())
                        rows.append(signed(elements, counts.astype(float) if counted else np.ones(len(elements))))
                    at += 1
            n, f1, f2, bands, sketch = zip(*rows) if rows else [[]] * 5
            long, longs = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, long), pa.array(n, long), pa.array(f1, long), pa.array(f2, long),
                 pa.array(list(bands), longs), pa.array(list(sketch), longs)],
                names=["doc_id", "n", "f1", "f2", "bands", "sketch"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(
        work, "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def _agreeing(left: str, right: str) -> Column:
    """Coordinates whose two bits agree, of the coordinates sketched in the words `left`0 ... ."""
    words = -(-BANDS * ROWS // 32)
    total = F.lit(32 * words)
    for k in range(words):
        differ = F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))
        either = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total - F.bit_count(either)
    return total - (32 * words - BANDS * ROWS)  # the rest of the last word is zero in both


def _may_be_similar(similarity: float) -> Column:
    """Of the columns x_... and l_...: sizes and sketches allow the similarity."""
    sizes = F.least("x_n", "l_n") >= similarity * F.greatest("x_n", "l_n")
    return sizes & (_agreeing("x_s", "l_s") >= LEAST_AGREEING)


def verified(docs: DataFrame, pairs: DataFrame, similarity: float, counted: bool = False) -> DataFrame:
    """a, b of the pairs whose whole sets are similar enough.

    Each text goes to the leaders (`b`) it is compared with; a leader stands first in its group and
    the others stream past it, so memory is two texts. Large groups are split, the leader copied.
    """
    pairs = pairs.select("a", "b").distinct()
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    members = pairs.join(groups, "b").select(
        F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"),
        F.lit(1).alias("turn"))
    leaders = groups.select(
        F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("turn"))
    # A member has one leader for each band at most; a leader one row for each part of its group.
    wanted = members.unionByName(leaders).groupBy("id").agg(
        F.collect_list(F.struct("b", "part", "turn")).alias("uses"))
    texts = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").join(
        wanted, F.col("doc_id") == F.col("id")).select("id", "uses", "text")

    def shingled(batches):
        for batch in batches:
            rows = []
            at = 0
            for block in _lowered(batch):
                for elements, counts in text_shingles(block):
                    uses = batch.column("uses")[at].as_py()
                    packed = (elements.tobytes(), counts.astype(np.int32).tobytes() if counted else b"")
                    rows += [(batch.column("id")[at].as_py(), u["b"], u["part"], u["turn"], *packed) for u in uses]
                    at += 1
                    if len(rows) > 2000:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    def _batch(rows):
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["id", "b", "part", "turn", "elements", "counts"])

    def compare(batches):
        leader, known = None, []
        for batch in batches:
            a, b = [], []
            for id_, with_, part, turn, elements, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(elements, _U)
                count = np.frombuffer(counts, np.int32) if counted else None
                if turn == 0:
                    # Rows that repeat an id give several leaders.
                    known = [*known, (own, count)] if leader == (with_, part) else [(own, count)]
                    leader = (with_, part)
                elif any(jaccard(own, count, *other) >= similarity for other in known):
                    a.append(id_)
                    b.append(with_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (
        texts.mapInArrow(shingled, "id long, b long, part int, turn int, elements binary, counts binary")
        .repartition("b", "part").sortWithinPartitions("b", "part", "turn")
        .mapInArrow(compare, "a long, b long").distinct()
    )


def jaccard(a: np.ndarray, a_counts, b: np.ndarray, b_counts) -> float:
    """Of two ascending sets, weighted by counts where these are given."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a if len(b) else np.zeros(len(a), bool)
    if a_counts is None:
        shared = int(same.sum())
        return shared / max(len(a) + len(b) - shared, 1)
    shared = int(np.minimum(a_counts[same], b_counts[at[same]]).sum())
    return shared / max(int(a_counts.sum()) + int(b_counts.sum()) - shared, 1)


def _pairs_across(placed: DataFrame, own: list[str], similarity: float) -> DataFrame:
    """a, b: pairs of a bucket in different components, `b` outside the leader's, that may be similar."""
    outside = placed.where("label <> main").select(
        "bucket", F.col("label").alias("x_label"), F.col("l_id").alias("x_leader"),
        *[F.col(c).alias(f"x_{c}") for c in own])
    others = placed.select("bucket", F.col("label").alias("l_label"), "main", *[F.col(c).alias(f"l_{c}") for c in own])
    return outside.join(others, "bucket").where(
        (F.col("x_label") != F.col("l_label")) & (F.col("l_id") != F.col("x_leader"))
        & ((F.col("l_label") == F.col("main")) | (F.col("x_id") < F.col("l_id")))
        & _may_be_similar(similarity)
    ).select(F.col("l_id").alias("a"), F.col("x_id").alias("b"))


def _links_in_blocks(docs: DataFrame, placed: DataFrame, sets: DataFrame, similarity: float,
                     counted: bool) -> DataFrame:
    """a, b: verified links of the same pairs. The outsiders of a bucket come in blocks, every text of
    the bucket streams past each block. A pair is compared in the first band that it shares only."""
    words = -(-BANDS * ROWS // 32)
    parts = F.ceil(F.col("all") / (8 * BLOCK)).cast("int")
    blocks_ = F.ceil(F.col("outside") / BLOCK).cast("int")

    def dealt(count: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), count).cast("int")

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    is_out = F.col("label") != F.col("main")
    members = placed.select("id", "bucket", "label", (~is_out).alias("inside"), dealt(parts, 1).alias("part"),
                            blocks_.alias("_n"), F.lit(1).alias("turn")).withColumn("block", every(F.col("_n"))).drop("_n")
    outside = placed.where(is_out).select(
        "id", "bucket", "label", F.lit(False).alias("inside"), dealt(blocks_, 2).alias("block"), parts.alias("_n"),
        F.lit(0).alias("turn")).withColumn("part", every(F.col("_n"))).drop("_n")
    uses = members.unionByName(outside).groupBy("id").agg(
        F.max("label").alias("label"), F.collect_list(F.struct("bucket", "block", "part", "turn", "inside")).alias("uses"))
    known = uses.join(sets.select(F.col("id").alias("s_id"), "bands", F.array(*[F.col(f"s{k}") for k in range(words)]).alias(
        "sketch")), F.col("id") == F.col("s_id")).drop("s_id")
    texts = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").join(
        known, F.col("doc_id") == F.col("id")).select("id", "label", "uses", "bands", "sketch", "text")
    kinds = {"bucket": pa.int64(), "block": pa.int32(), "part": pa.int32(), "turn": pa.int32(), "inside": pa.bool_(),
             "id": pa.int64(), "label": pa.int64(), "bands": pa.binary(), "sketch": pa.binary(), "elements": pa.binary(),
             "counts": pa.binary()}

    def arrow(rows):
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    def shingled(batches):
        for batch in batches:
            rows, at = [], 0
            for block in _lowered(batch):
                for elements, counts in text_shingles(block):
                    id_, label, uses, bands, sketch = (batch.column(c)[at].as_py() for c in batch.schema.names[:5])
                    held = (id_, label, np.array(bands, np.int64).tobytes(), np.array(sketch, np.int64).tobytes(),
                            elements.tobytes(), counts.astype(np.int32).tobytes() if counted else b"")
                    rows += [(u["bucket"], u["block"], u["part"], u["turn"], u["inside"], *held) for u in uses]
                    at += 1
                    if len(rows) > 2000:
                        yield arrow(rows)
                        rows = []
            yield arrow(rows)

    def compare(batches):
        group, held = None, []
        table = None
        for batch in batches:
            a, b = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                bucket, block, part, turn, inside, id_, label, bands, sketch, elements, counts = row
                if group != (bucket, block, part):
                    group, held, table = (bucket, block, part), [], None
                own = (id_, label, np.frombuffer(bands, np.int64), np.frombuffer(sketch, _U),
                       np.frombuffer(elements, _U), np.frombuffer(counts, np.int32) if counted else None)
                if turn == 0:
                    held.append(own)
                    continue
                if table is None:
                    table = _outsiders(held)
                for k in _possible(table, own, inside, bucket, similarity):
                    if jaccard(own[4], own[5], held[k][4], held[k][5]) >= similarity:
                        a.append(id_)
                        b.append(held[k][0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    schema = ("bucket long, block int, part int, turn int, inside boolean, id long, label long, bands binary,"
              " sketch binary, elements binary, counts binary")
    return (
        texts.mapInArrow(shingled, schema).repartition("bucket", "block", "part")
        .sortWithinPartitions("bucket", "block", "part", "turn").mapInArrow(compare, "a long, b long").distinct()
    )


def _outsiders(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """Ids, labels, bands, sketches and numbers of elements of a block's outsiders."""
    if not held:
        return tuple(np.zeros((0, n), np.int64) for n in (1, 1, 1, 1, 1))
    return (np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.stack([h[2] for h in held]),
            np.stack([h[3] for h in held]), np.array([len(h[4]) for h in held]))


def _possible(table: tuple[np.ndarray, ...], own: tuple, inside: bool, bucket: int, similarity: float) -> np.ndarray:
    """Which outsiders a text is compared with in this bucket."""
    ids, labels, bands, sketches, sizes = table
    if not len(ids):
        return np.zeros(0, np.int64)
    id_, label, own_bands, own_sketch, elements, _ = own
    n = len(elements)
    found = (labels != label) & (np.minimum(sizes, n) >= similarity * np.maximum(sizes, n))
    if not inside:
        found &= ids < id_
    at = np.flatnonzero(found)
    differ = sketches[at] ^ own_sketch
    either = (differ | differ >> _U(1)) & _U(0x5555555555555555)
    agreeing = BANDS * ROWS - np.bitwise_count(either).sum(axis=1).astype(np.int64)
    at = at[agreeing >= LEAST_AGREEING]
    same = bands[at] == own_bands
    first = np.where(same.any(axis=1), own_bands[same.argmax(axis=1)], bucket)
    return at[first == bucket]


def classes(docs: DataFrame, similarity: float = SIMILARITY, counted: bool = False,
            outsiders: int = OUTSIDERS) -> DataFrame:
    """doc_id, class_id for every row of `docs`: class_id is the smallest doc_id of the documents
    that links of at least `similarity` connect, the document itself included.

    Null and empty texts, and texts without a word, are classes of their own. Equal texts share a
    class, rows that share a doc_id too. A row without a doc_id has no class (null). Texts of fewer
    than five words are similar when their words are equal. Other columns are not looked at.
    """
    words = -(-BANDS * ROWS // 32)
    all_signed = stored(signatures(docs, counted), "signatures")
    # One row for each distinct set: the smallest id speaks for it.
    sets = all_signed.groupBy("f1", "f2").agg(
        F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("s")
    ).select("f1", "f2", F.col("s.doc_id").alias("id"), F.col("s.n").alias("n"), "s.bands",
             *[F.element_at("s.sketch", k + 1).alias(f"s{k}") for k in range(words)])
    sets = stored(sets, "sets")
    own = ["id", "n", *(f"s{k}" for k in range(words))]
    in_buckets = sets.select(*own, F.explode("bands").alias("bucket"))
    buckets = in_buckets.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min(F.struct(*own)).alias("leader")).where("size > 1")
    buckets = buckets.select("bucket", *[F.col(f"leader.{c}").alias(f"l_{c}") for c in own])
    met = stored(in_buckets.join(buckets, "bucket"), "buckets")

    to_leaders = met.where("id <> l_id").select(
        *[F.col(c).alias(f"x_{c}") for c in own], *[f"l_{c}" for c in own]
    ).where(_may_be_similar(similarity)).select(F.col("x_id").alias("a"), F.col("l_id").alias("b"))
    first = stored(verified(docs, to_leaders, similarity, counted), "links")
    found = components(first)

    # Buckets that still hold several components: everyone outside the leader's against all others.
    label = found.select(F.col("id").alias("c_id"), "label")
    placed = met.join(label, F.col("id") == F.col("c_id"), "left").withColumn(
        "label", F.coalesce("label", "id")).select("bucket", "l_id", "label", *own)
    placed = stored(placed.join(
        label.select(F.col("c_id").alias("d_id"), F.col("label").alias("main")),
        F.col("l_id") == F.col("d_id"), "left"
    ).withColumn("main", F.coalesce("main", "l_id")).drop("d_id"), "placed")
    mixed = stored(placed.groupBy("bucket").agg(
        F.count("*").alias("all"), F.count_if(F.col("label") != F.col("main")).alias("outside")
    ).where("outside > 0").withColumnRenamed("bucket", "m_bucket"), "mixed-buckets")
    placed = placed.join(mixed, F.col("bucket") == F.col("m_bucket")).drop("m_bucket")
    few, many = placed.where(F.col("outside") <= outsiders), placed.where(F.col("outside") > outsiders)
    links = first.union(verified(docs, _pairs_across(few, own, similarity), similarity, counted)).union(
        _links_in_blocks(docs, many, sets, similarity, counted))
    found = components(stored(links, "all-links"))

    named = sets.select("f1", "f2", "id").join(
        found.withColumnRenamed("id", "m_id"), F.col("id") == F.col("m_id"), "left"
    ).select("f1", "f2", F.coalesce("label", "id").alias("class_id"))
    by_doc = all_signed.select("doc_id", "f1", "f2").join(named, ["f1", "f2"]).groupBy(
        F.col("doc_id").alias("k_id")).agg(F.min("class_id").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(
        by_doc, F.col("doc_id") == F.col("k_id"), "left"
    ).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that speak for their class, one for each doc_id; rows without one stay."""
    known = stored(classes(docs, **options).where("doc_id = class_id").select(
        F.col("doc_id").alias("__id")).distinct(), "kept")
    kept = docs.join(known, F.col("doc_id").cast("long") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))

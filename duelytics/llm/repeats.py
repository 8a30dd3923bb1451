"""Removal of long byte strings that stand earlier in the corpus.

Every byte covered by a `LENGTH`-byte string that also starts earlier goes. Texts that equal an
earlier one as a whole are settled by their hash. In the others every window of `LENGTH` bytes has an
anchor, the least hash among the `GRAM`-byte strings in it; equal windows have equal anchors at equal
places. Consecutive windows with one anchor are a piece. Only pieces whose anchor occurs again in the
corpus matter: equal pieces of one anchor are settled by the first of them, and the first pieces of an
anchor that share enough around it are put into run-length indexes of bounded size, all pieces of an
anchor into the same one, whose matching statistics mark the windows that stand earlier.

An anchor with more distinct pieces than an index should hold has its windows compared one by one,
as hashes of the whole window, by grouping.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from duelytics.llm.run_index import LIMIT, earliest
from duelytics.llm.store import discard, new_folder, remove, stored
from duelytics.llm.words import mix

LENGTH, GRAM = 100, 24
SEGMENT = 1 << 20          # bytes looked at together
CROWD = 5_900              # distinct pieces of one anchor that one index takes at most

_U = np.uint64
_BYTE = mix(np.arange(256, dtype=_U) + _U(0xB17E))
_C = [_U(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(8)]
_LOW = _U((1 << 24) - 1)


def _hashes(data: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... 64 bytes from each position."""
    levels = [_BYTE[data]]
    for k in range(6):
        h, step = levels[-1], 1 << k
        levels.append(h[:-step] * _C[k] + h[step:] if len(h) > step else h[:0])
    return levels


class Pieces:
    """Pieces of the texts of one block: their text, first window, number of windows, anchor, hash of
    the piece and of the 38 bytes on either side of the anchor."""

    def __init__(self, parts: list[tuple[int, bytes, int, int]], length: int = LENGTH, gram: int = GRAM):
        """`parts`: (row, text, first window, end of windows); a long text comes in several."""
        side, margin = (length - gram) // 2, 2 * length
        data, cuts = [], []
        at = 0
        for row, text, first, stop in parts:
            low, high = max(0, first - margin), min(len(text), stop + length + margin)
            cuts.append((row, at - low, at, at + high - low, first + at - low, stop + at - low))
            data.append(text[low:high])
            at += high - low
        data = np.frombuffer(b"".join(data), np.uint8)
        # For each part: row, place of the text's begin, bounds of its bytes, bounds of its windows.
        row, origin, low, high, first, stop = np.array(cuts, np.int64).reshape(-1, 6).T
        levels = _hashes(data)
        h8, h16, h64 = levels[3], levels[4], levels[6]
        grams = mix(h16[: len(data) - gram + 1] * _C[3] + h8[16 : len(data) - gram + 17])
        # Least hash in a window, the leftmost of equal ones: high bits of the hash, then the place.
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=_U)
        width, have = length - gram + 1, 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        n = len(data) - length + 1
        key = np.minimum(key[:n], key[width - have : width - have + n])
        anchor = (key & _LOW).astype(np.int64)
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, stop, -1)
        valid = np.cumsum(inside[:-1]) > 0
        edge = np.ones(n, bool)
        edge[1:] = anchor[1:] != anchor[:-1]
        edge[first[first < n]] = True
        starts = np.flatnonzero(edge & valid)
        # A piece ends at the next edge or where its part's windows end.
        edges = np.append(np.flatnonzero(edge), n)
        of = np.searchsorted(first, starts, "right") - 1
        ends = np.minimum(edges[np.searchsorted(edges, starts, "right")], stop[of])
        anchor = anchor[starts]
        last = ends + length - 1                                # end of the piece's bytes
        self.row, self.start, self.windows = row[of], starts - origin[of], ends - starts
        self.anchor = grams[anchor]
        self.piece = mix(mix(mix(h64[starts] + (last - starts).astype(_U)) ^ h64[np.minimum(starts + 56, last - 64)])
                         ^ h64[last - 64]) ^ mix(((anchor - starts) << 9).astype(_U) + _U(5))
        # Windows that agree hold the same bytes on the longer side of the anchor.
        h32, h4, h2 = levels[5], levels[2], levels[1]

        def beside(place: np.ndarray, fits: np.ndarray, salt: int) -> np.ndarray:
            place = np.where(fits, place, 0)
            value = mix(h32[place] * _C[2] * _C[1] + h4[place + 32] * _C[1] + h2[place + 36])
            lone = mix((self.row * 2654435761 + self.start).astype(_U) ^ _U(salt)) | _U(1)
            return np.where(fits, value & ~_U(1), lone)          # odd: cannot agree with any other

        if side != 38:
            raise ValueError("the sides are hashed as 38 bytes")
        self.before = beside(anchor - side, anchor - side >= low[of], 0x1CEB00DA)
        self.after = beside(anchor + gram, anchor + gram + side <= high[of], 0x5EED5)


def cut_texts(texts: list[bytes], length: int = LENGTH) -> Iterator[list[tuple[int, bytes, int, int]]]:
    """Parts of texts in groups of about SEGMENT bytes; texts without a window are left out."""
    held, total = [], 0
    for row, text in enumerate(texts):
        windows = len(text) - length + 1
        for first in range(0, max(0, windows), SEGMENT):
            stop = min(first + SEGMENT, windows)
            held.append((row, text, first, stop))
            total += stop - first + 3 * length
            if total >= SEGMENT:
                yield held
                held, total = [], 0
    if held:
        yield held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _bytes(column) -> list[bytes]:
    return [t.as_py().encode("utf-8", "surrogatepass") for t in column]


def anchors(texts: DataFrame) -> DataFrame:
    """doc, text_hash, anchor of every piece."""

    def work(batches):
        for batch in batches:
            doc, text_hash = batch.column("doc").to_numpy(), batch.column("t1").to_numpy()
            for parts in cut_texts(_bytes(batch.column("text"))):
                found = Pieces(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[found.row]), pa.array(text_hash[found.row]), _signed(found.anchor)],
                    names=["doc", "t1", "anchor"])

    return texts.select("doc", "t1", "text").mapInArrow(work, "doc long, t1 long, anchor long")


def pieces(texts: DataFrame) -> DataFrame:
    """The pieces of `texts` whose anchors are in the text's list `wanted`."""
    names = ["doc", "t1", "start", "windows", "anchor", "piece", "before", "after"]

    def work(batches):
        for batch in batches:
            doc, text_hash = batch.column("doc").to_numpy(), batch.column("t1").to_numpy()
            lists = batch.column("wanted")
            for parts in cut_texts(_bytes(batch.column("text"))):
                found = Pieces(parts)
                rows = sorted({part[0] for part in parts})
                wanted = [lists[r].values.to_numpy() for r in rows]
                of = np.repeat(np.array(rows), [len(w) for w in wanted])
                # Anchors of a text, tagged with its row.
                tagged = np.concatenate(wanted).view(_U) ^ mix(of.astype(_U) + _U(1))
                held = np.isin(found.anchor ^ mix(found.row.astype(_U) + _U(1)), tagged)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[found.row[held]]), pa.array(text_hash[found.row[held]]),
                     pa.array(found.start[held]), pa.array(found.windows[held].astype(np.int32)),
                     *(_signed(getattr(found, c)[held]) for c in names[4:])], names=names)

    return texts.select("doc", "t1", "wanted", "text").mapInArrow(
        work, "doc long, t1 long, start long, windows int, anchor long, piece long, before long, after long")


def _sliced(texts: DataFrame) -> DataFrame:
    """The bytes of the pieces in each text's list `wanted`."""

    def work(batches):
        for batch in batches:
            rows = []
            for doc, t1, text, uses in zip(batch.column("doc").to_pylist(), batch.column("t1").to_pylist(),
                                           _bytes(batch.column("text")), batch.column("wanted")):
                for use in uses.as_py():
                    start, windows = use["start"], use["windows"]
                    rows.append((use["anchor"], doc, t1, start, windows, text[start : start + windows + LENGTH - 1]))
            columns = zip(*rows) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["anchor", "doc", "t1", "start", "windows", "data"])

    return texts.select("doc", "t1", "wanted", "text").mapInArrow(
        work, "anchor long, doc long, t1 long, start long, windows int, data binary")


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive window starts, as the bytes they cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    low = starts[np.append(0, cuts + 1)]
    high = starts[np.append(cuts, len(starts) - 1)] + LENGTH
    return list(zip(low.tolist(), high.tolist()))


_SPANS = "doc long, t1 long, low long, high long"


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "t1", "low", "high"])


def indexed_spans(found: DataFrame, limit: int = LIMIT // 2) -> DataFrame:
    """doc, t1, low, high of the bytes of pieces that stand in an earlier piece of their anchor."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        # By document and place; rows that repeat a text give a piece twice.
        rows = [next(same) for _, same in groupby(sorted(rows, key=lambda r: r[1:4]), key=lambda r: r[1:4])]
        marked = earliest([r[5] for r in rows], LENGTH)
        return _span_batch([
            (r[1], r[2], r[3] + low, r[3] + high) for r, starts in zip(rows, marked) for low, high in _spans(starts)])

    def work(batches):
        held, total, group = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != group:
                    if total >= limit:
                        yield solve(held)
                        held, total = [], 0
                    group = row[0]
                held.append(row)
                total += len(row[5]) + 1
        if held:
            yield solve(held)

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(work, _SPANS)


def compared_spans(found: DataFrame) -> DataFrame:
    """The same for the pieces of crowded anchors, by the hash of every whole window."""

    def exploded(batches):
        for batch in batches:
            for anchor, doc, t1, start, windows, data in zip(*(c.to_pylist() for c in batch.columns)):
                digests = [hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest() for k in range(windows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([doc] * windows, pa.int64()),
                     pa.array([t1] * windows, pa.int64()), pa.array(range(start, start + windows), pa.int64())],
                    names=["digest", "doc", "t1", "low"])

    windows = found.select("anchor", "doc", "t1", "start", "windows", "data").mapInArrow(
        exploded, "digest binary, doc long, t1 long, low long")
    place = F.struct("doc", "t1", "low")
    first = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(first, "digest").where(place != F.col("first")).select(
        "doc", "t1", "low", (F.col("low") + LENGTH).alias("high"))


def removed_spans(texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc, t1, low, high: covered bytes; spans of one text may overlap. `texts`: doc, t1, text, all
    different, bucketed by doc and t1, so that the joins need no shuffle of texts."""
    by_text = stored(anchors(texts), "anchors")
    # Stored, so that the join stands on plain exchanges and a frequent anchor's rows can be split.
    again = stored(by_text.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "again")
    lists = by_text.join(again, "anchor").groupBy(F.col("doc").alias("d"), F.col("t1").alias("t")).agg(
        F.collect_set("anchor").alias("wanted"))
    found = stored(pieces(texts.join(lists, (F.col("doc") == F.col("d")) & (F.col("t1") == F.col("t")))), "pieces")
    discard(by_text, again)

    # Equal pieces: all windows of the later ones stand earlier.
    place = F.struct("doc", "t1", "start", "windows", "before", "after")
    firsts = stored(found.groupBy("anchor", "piece").agg(F.min(place).alias("first"), F.count("*").alias("n")).select(
        "anchor", "piece", "n", "first.*"), "first-pieces")
    later = found.join(
        firsts.where("n > 1").select("anchor", "piece", F.col("doc").alias("d"), F.col("t1").alias("t"),
                                     F.col("start").alias("s")), ["anchor", "piece"]
    ).where((F.col("doc") != F.col("d")) | (F.col("t1") != F.col("t")) | (F.col("start") != F.col("s")))
    settled = later.select("doc", "t1", F.col("start").alias("low"),
                           (F.col("start") + F.col("windows") + LENGTH - 1).alias("high"))

    # First pieces that share a side of the anchor with another one may share windows with it.
    def shared(side: str) -> DataFrame:
        return firsts.groupBy("anchor", side).agg(F.count("*").alias("n")).where("n > 1").select(
            F.col("anchor").alias("a"), F.col(side).alias("v"))

    live = None
    for side in ("before", "after"):
        on = shared(side)
        part = firsts.join(on, (F.col("anchor") == F.col("a")) & (F.col(side) == F.col("v")), "left_semi").select(
            "anchor", "doc", "t1", "start", "windows")
        live = part if live is None else live.unionByName(part)
    live = stored(live.distinct(), "live-pieces")
    lists = live.groupBy(F.col("doc").alias("d"), F.col("t1").alias("t")).agg(
        F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted"))
    data = stored(_sliced(texts.join(lists, (F.col("doc") == F.col("d")) & (F.col("t1") == F.col("t")))), "piece-bytes")
    crowded = stored(
        live.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"), "crowded")
    discard(live)
    return settled.unionByName(indexed_spans(data.join(crowded, "anchor", "left_anti"))).unionByName(
        compared_spans(data.join(crowded, "anchor", "left_semi")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`.

    Null texts count as empty. Rows without a doc_id come before all others. Rows that repeat a doc_id
    and its text are one text, none earlier than the other; different texts of one doc_id are ordered
    by a hash of the text. Other columns are not looked at, an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("t1", F.xxhash64("text"))
    keys = rows.select("doc_id", "doc", "t1", F.xxhash64(F.lit(1), "text").alias("t2"),
                       F.octet_length("text").cast("long").alias("n_bytes"),
                       F.when(F.octet_length("text") < LENGTH, F.sha2("text", 256)).alias("short"))
    firsts = stored(keys.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.count("*").alias("rows")), "texts")
    # Rows that repeat an id and its text become one here and take its result at the end.
    repeated = stored(keys.groupBy("doc", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("doc").alias("of"), F.col("t1").alias("by")).distinct(), "repeated")
    known = (F.col("doc") == F.col("of")) & (F.col("t1") == F.col("by"))
    # Distinct texts, saved once by document: three joins with what is found out about them follow.
    name, buckets = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.join(
        firsts.select(F.col("first").alias("f"), F.col("t1").alias("h")).distinct(),
        (F.col("doc") == F.col("f")) & (F.col("t1") == F.col("h")), "left_semi")
    distinct = distinct.join(repeated, known, "left_anti").unionByName(
        distinct.join(repeated, known, "left_semi").dropDuplicates(["doc", "t1"]))
    folder = new_folder(spark, "texts")
    (distinct.write.bucketBy(buckets, "doc", "t1").sortBy("doc", "t1").option("compression", "zstd")
     .option("path", folder).saveAsTable(name))
    texts = spark.table(name)
    marked = stored(removed_spans(texts.select("doc", "t1", "text"), crowd), "spans")
    spans = marked.groupBy(F.col("doc").alias("d"), F.col("t1").alias("t")).agg(
        F.collect_set(F.struct("low", "high")).alias("spans"))

    def kept(batches):
        for batch in batches:
            out = []
            for text, found in zip(_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                gone = merged([(s["low"], s["high"]) for s in found or []])
                digest, at = hashlib.sha256(), 0
                for low, high in gone:
                    digest.update(text[at:low])
                    at = high
                digest.update(text[at:])
                out.append((len(text), sum(high - low for low, high in gone), len(gone), digest.hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc", "t1", "doc_id")), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc", "t1", *result])

    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    own = stored(texts.join(spans, (F.col("doc") == F.col("d")) & (F.col("t1") == F.col("t")), "left").select(
        "doc", "t1", "doc_id", "text", "spans").mapInArrow(
        kept, "doc long, t1 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "kept")
    spark.sql(f"DROP TABLE {name}")
    remove(spark, folder)
    discard(marked)
    lone = own.join(repeated, known, "left_anti").select(*result)
    many = own.join(repeated, known, "left_semi").drop("doc_id").join(keys.select("doc_id", "doc", "t1"), ["doc", "t1"]).select(*result)
    # Later copies of a text: all of it stands earlier, or nothing when it is too short.
    whole = F.col("n_bytes") >= LENGTH
    copies = keys.join(firsts.where("rows > 1"), ["t1", "t2"]).where("doc <> first").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("short", F.sha2(F.lit(""), 256)).alias("kept_sha256"))
    return lone.unionByName(many).unionByName(copies)

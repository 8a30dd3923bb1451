"""Divergence of sources by smoothed term shares, from exact products of one-hot levels.

How far two sources of a language lie apart is a sum over terms of |p - q|, and a source's share p of
a term depends on the term's count in it only. So it is enough to know, for two sources, how many terms
have count i in the one and count j in the other. With one indicator column for every (source, count)
and one row for every term, all these joint tables are the product of the transposed matrix with
itself; each cell is then priced once by |p - q|.

The matrix is cut into blocks of about `TERMS` terms and `SOURCES` sources. A task holds the cells of
one block of terms and two blocks of sources, and multiplies slices of at most `COLUMNS` columns, so
its memory is bounded by these numbers. Entries are counts of at most the terms of a block, far below
2^24, so single precision is exact; prices and sums are 64-bit integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from duelytics.llm.store import stored

# Bytes of a text as UTF-8: A-Z in lower case, a-z and everything beyond ASCII as it is, the rest a space.
TO_TERMS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
MIN_DOCS, SMOOTHING, SCALE, SHOWN = 30, 5, 1_000_000_000, 50
TERMS, SOURCES, COLUMNS = 2048, 16, 1024
HELD = 400_000  # counts a task adds up before it hands them on


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n, docs: occurrences and rows with the term, in parts that add up."""

    def work(batches):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        distinct = 0

        def flushed():
            for (lang, source), (n, rows) in counts.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                     pa.array([rows[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        for batch in batches:
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for lang, source, text in zip(langs, sources, batch.column("text")):
                terms = (text.as_py() or "").encode("utf-8", "replace").translate(TO_TERMS).split()
                n, rows = counts.setdefault((lang, source), (Counter(), Counter()))
                distinct -= len(n)
                n.update(terms)
                rows.update(set(terms))
                distinct += len(n)
                if distinct >= held:
                    yield from flushed()
                    distinct = 0
        yield from flushed()

    return docs.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)) in whole numbers."""
    wide = "decimal(38,0)"
    over = F.lit(SCALE).cast(wide) * (n + SMOOTHING).cast("decimal(19,0)")
    below = (total + SMOOTHING * terms).cast(wide)
    return F.call_function("div", over.cast(wide), below) + 1


def joint_values(rows: pa.Table) -> tuple[list[int], list[int], list[int], int]:
    """(a, b, value) of every source of block `a` against every source of block `b`, over the terms
    that some of them has here, and how many terms these are.

    `rows`: side (0 or 1), number, zero (the price of count 0), term (null in the row that only
    announces a source), n, p.
    """
    side, number = rows["side"].to_numpy(), rows["number"].to_numpy()
    term = rows["term"].combine_chunks().dictionary_encode()
    at = term.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    n, p, zero = (rows[c].to_numpy() for c in ("n", "p", "zero"))
    height = len(term.dictionary)

    def columns(mine: np.ndarray):
        """Source numbers, and of each indicator column the source's place, the price and the terms."""
        names = np.unique(number[mine])
        owner, price, members = [], [], []
        for place, name in enumerate(names):
            own = mine & (number == name)
            full = own & (at >= 0)
            levels, which = np.unique(n[full], return_inverse=True)
            places = at[full]
            missing = np.ones(height, bool)
            missing[places] = False
            owner.append(np.full(len(levels) + 1, place))
            level_price = np.zeros(len(levels), np.int64)
            level_price[which] = p[full]
            price.append(np.concatenate([[zero[own][0]], level_price]))
            order = np.argsort(which, kind="stable")
            members.append(np.flatnonzero(missing))
            members += np.split(places[order], np.searchsorted(which[order], np.arange(1, len(levels))))[:len(levels)]
        return names, np.concatenate(owner), np.concatenate(price), members

    def slices(owner, price, members):
        for low in range(0, len(owner), COLUMNS):
            part = slice(low, low + COLUMNS)
            matrix = np.zeros((height, len(owner[part])), np.float32)
            for column, places in enumerate(members[part]):
                matrix[places, column] = 1
            first = np.flatnonzero(np.diff(owner[part], prepend=-1))
            yield owner[part][first], first, price[part], matrix

    left, right = columns(side == 0), columns(side == 1)
    values = np.zeros((len(left[0]), len(right[0])), np.int64)
    for a, a_first, a_price, a_matrix in slices(*left[1:]):
        for b, b_first, b_price, b_matrix in slices(*right[1:]):
            joint = (a_matrix.T @ b_matrix).astype(np.int64)
            priced = joint * np.abs(a_price[:, None] - b_price[None, :])
            values[np.ix_(a, b)] += np.add.reduceat(np.add.reduceat(priced, a_first, 0), b_first, 1)
    a, b = (x.ravel() for x in np.meshgrid(left[0], right[0], indexing="ij"))
    return a, b, values.ravel(), height


def distances(cells: DataFrame, groups: DataFrame, terms: int, sources: int) -> DataFrame:
    """lang, a, b, value: sum of |p - q| over all kept terms, for the numbers a <> b of two sources.

    `cells`: lang, number, term, n, p (n > 0); `groups`: lang, number, zero, kept (terms of the lang).
    """
    last = Window.partitionBy("lang")
    placed = groups.withColumn("block", F.floor(F.col("number") / sources)).withColumn(
        "blocks", F.max(F.floor(F.col("number") / sources)).over(last)).withColumn(
        "pieces", F.ceil(F.col("kept") / terms)).where("pieces > 0")
    # The pairs of source blocks that a source belongs to, once as the left and once as the right one.
    pairs = F.concat(
        F.transform(F.sequence(F.col("block"), F.col("blocks")), lambda other: F.struct(
            F.lit(0).alias("side"), F.col("block").alias("x"), other.alias("y"))),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("block")), lambda other: F.struct(
            F.lit(1).alias("side"), other.alias("x"), F.col("block").alias("y"))))
    spread = placed.select("lang", "number", "zero", "pieces", F.explode(pairs).alias("q")).select(
        "lang", "number", "zero", "pieces", "q.*")
    named = spread.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "x", "y", "side", "number",
        "zero", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"))
    filled = cells.join(spread, ["lang", "number"]).select(
        "lang", F.pmod(F.xxhash64("term"), "pieces").alias("piece"), "x", "y", "side", "number", "zero", "term", "n", "p")

    def work(rows: pa.Table) -> pa.Table:
        a, b, value, height = joint_values(rows)
        lang = pa.array([rows["lang"][0].as_py()] * len(a), pa.string())
        return pa.table([lang, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.int64()),
                         pa.array(np.full(len(a), height), pa.int64())], names=["lang", "a", "b", "value", "seen"])

    parts = named.unionByName(filled).groupBy("lang", "piece", "x", "y").applyInArrow(
        work, "lang string, a long, b long, value long, seen long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # A pair of different blocks was met once, a pair within a block twice.
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    within = F.floor(F.col("a") / sources) == F.floor(F.col("b") / sources)
    return summed.where("a <> b").select(
        "lang", F.explode(F.when(within, F.array(there)).otherwise(F.array(there, back))).alias("pair"), "value", "seen"
    ).select("lang", "pair.*", "value", "seen")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, shown: int = SHOWN, terms: int = TERMS,
          sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others
    (part `pair`, all of them) and the terms it holds more often than its language (part `term`).

    Null text, lang and source count as ''. A document is a row: rows that share a doc_id count one
    by one, equal rows too. Sources without a term stand in the pairs; without a kept term all pairs
    have value 0. Equal values rank by item. An empty table gives no rows. Other columns are not
    looked at.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = stored(term_counts(docs).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= min_docs).drop("docs")
    cells = stored(counted.drop("docs").join(kept, ["lang", "term"]), "term-cells")

    langs = cells.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # One row for each source of a language; the numbers are places in blocks.
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(
        langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"]).withColumn("number", number.cast("long"))
    groups = stored(groups.withColumn("zero", F.when(F.col("kept") > 0, share(
        F.lit(0).cast("long"), F.col("total"), F.col("kept")))), "groups")

    own = cells.join(groups, ["lang", "source"])
    priced = own.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    far = distances(priced.select("lang", "number", "term", "n", "p"), groups, terms, sources)

    a = groups.select("lang", "source", F.col("number").alias("a"), F.col("zero").alias("a_zero"), "kept")
    b = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("zero").alias("b_zero"))
    # Terms that neither of two sources' blocks holds have count 0 in both.
    pairs = a.join(b, "lang").where("a <> b").join(far, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.coalesce(F.col("value") + (F.col("kept") - F.col("seen")) * F.abs(F.col("a_zero") - F.col("b_zero")),
                   F.lit(0)).cast("long").alias("value"))
    above = F.col("p") - share(F.col("all"), F.col("lang_total"), F.col("kept"))
    best = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         above.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(
        best.withColumn("rank", rank).where(F.col("rank") <= shown))

"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are filled like water: every source gets its weight's share, none more than `ceiling`
times its size, the excess goes to the others by weight. The mix is then dealt in blocks of equal
token counts. Blocks go to sources, and within a source to its shards, by the highest quotients
target / (2 * blocks so far + 1), which gives integer quotas. A shard is a seeded share of a
source's documents, laid end to end in seeded order; a quota beyond a whole pass takes whole
passes first, the rest is a run of blocks from a seeded place, around the end of the shard.

Shards hold about `SHARD` tokens and at most about `SHARD_ROWS` rows each, so no task grows with a source. What meets in one place is
one row for each source (targets) and, for each source, one row for each of its shards.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2
BLOCK, SHARD, SHARD_ROWS, SEED = 16, 2_000_000, 1_000_000, "mix"

WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Integer quotas of `seats` by highest quotients weight / (2 k + 1); ties go to the first.

    A divisor close to the right one gives all but a few seats at once; the rest are dealt (or
    taken back) one at a time by their quotients.
    """
    weights = np.asarray(weights, float)
    quotas = np.zeros(len(weights), np.int64)
    total = weights.sum()
    if seats <= 0 or total <= 0:
        return quotas
    low, high = 0.0, 2.0 * seats + len(weights)
    for _ in range(80):  # the scale at which rounding gives about all seats
        scale = (low + high) / 2
        if np.floor(weights / total * scale + 0.5).sum() > seats:
            high = scale
        else:
            low = scale
    quotas = np.floor(weights / total * low + 0.5).astype(np.int64)
    while quotas.sum() < seats:
        quotas[np.argmax(weights / (2 * quotas + 1))] += 1
    while quotas.sum() > seats:
        last = np.where(quotas > 0, weights / np.maximum(2 * quotas - 1, 1), np.inf)
        quotas[len(last) - 1 - np.argmin(last[::-1])] -= 1
    return quotas


def seeded(*columns: Column | str) -> Column:
    """32 bits of a digest: the same on every run and machine."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("\\N"))
                                           for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, ceiling=CEILING) -> DataFrame:
    """source, source_size, target. One row for each source meets in one window."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight)
    everything = Window.partitionBy()
    # If the sources before a row (by size for its weight) are full, the others share at this level.
    filled = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")
    ).rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("source_size").over(filled), F.lit(0))
    level = (share * F.sum("source_size").over(everything) - float(ceiling) * full) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    return (
        weighed.withColumn("level", level)
        .withColumn("target", F.least(
            float(ceiling) * F.col("source_size"), F.max("level").over(everything) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _shard_quotas(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's shards, by number: blocks for each by the tokens it holds."""
    rows = rows.sort_values("shard")
    quota = sainte_lague(rows.shard_size.to_numpy(), int(rows.quota.iloc[0]))
    return rows[["source", "shard", "shard_size"]].assign(quota=quota)


def _source_quotas(share: float, block: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(key=[(s is None, (s or "").encode()) for s in rows.source]).sort_values("key")
        seats = int(np.floor(share * rows.source_size.sum() / block + 0.5))
        return rows.assign(quota=sainte_lague(rows.target.to_numpy(), seats))[
            ["source", "source_size", "target", "quota"]]
    return work


def sized(docs: DataFrame, *carried: Column) -> DataFrame:
    """Source and words of each row, and two numbers from a digest of id and text: equal for equal rows only."""
    tag = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")),
                            F.coalesce("text", F.lit("\\N"))))
    return docs.select(
        *carried, F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(tag, 1, 8), 16, 10).cast("long").alias("deal"),
        F.conv(F.substring(tag, 9, 15), 16, 10).cast("long").alias("place"))


def _mix(sizes: DataFrame, weights, share, ceiling, block, shard, rows) -> DataFrame:
    """The rows of `sized` with source_size, target and taken."""
    per_source = sizes.groupBy(F.col("name").alias("source")).agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    shards = per_source.select(F.col("source").alias("s"), F.greatest(
        F.lit(1), F.ceil(F.col("source_size") / shard), F.ceil(F.col("rows") / rows)).alias("shards"))
    quotas = (
        targets(per_source.drop("rows"), weights, share, ceiling)
        .groupBy(F.lit(0).alias("all"))
        .applyInPandas(_source_quotas(share, block), "source string, source_size long, target double, quota long")
        .join(shards, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    )
    # Sources are few; Spark broadcasts the quotas when their size is small.
    dealt = sizes.join(quotas, F.col("name").eqNullSafe(F.col("source"))).withColumn(
        "shard", F.pmod("deal", "shards")).drop("name", "deal", "shards")
    shards = (
        dealt.groupBy("source", "shard")
        .agg(F.sum("size").alias("shard_size"), F.max("quota").alias("quota"))
        .groupBy("source")
        .applyInPandas(_shard_quotas, "source string, shard long, shard_size long, quota long")
        .select(F.col("source").alias("s"), F.col("shard").alias("n"), "shard_size",
                F.col("quota").alias("shard_quota"))
    )
    lying = Window.partitionBy("source", "shard").orderBy("place", "id", "size")
    laid = dealt.withColumn("end", F.sum("size").over(lying.rowsBetween(Window.unboundedPreceding, 0)))
    return taken(laid.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("n"))), block)


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, ceiling=CEILING, block=BLOCK, shard=SHARD,
        rows=SHARD_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`.

    Null texts have no words, so nothing of them is taken; a null source is a source of its own,
    the last one. Rows that repeat a doc_id stand side by side; which of two equal rows is taken
    first does not matter, as they are equal. Other columns are not looked at. An empty table, or
    one without a word, gives targets of 0. The result holds the key columns only.
    """
    sizes = sized(docs, F.col("doc_id"))
    return _mix(sizes, weights, share, ceiling, block, shard, rows).select(
        "doc_id", "size", "source_size", "target", "taken")


def taken(laid: DataFrame, block: int) -> DataFrame:
    """Words taken of a document that ends at `end` in a shard: whole passes, and its part of a run of
    words that begins at a seeded block and goes on at the shard's beginning. Blocks are counted by
    their words, so the last one of a shard, which may be short, is not taken for a full one."""
    quota = F.least(F.col("shard_quota") * block, 2 * F.col("shard_size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block))
    start = F.col("end") - F.col("size")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), high) - F.greatest(start, low))

    return (
        laid.withColumn("passes", F.floor(quota / F.greatest(F.lit(1), F.col("shard_size"))))
        .withColumn("rest", quota - F.col("passes") * F.col("shard_size"))
        .withColumn("first", block * F.pmod(seeded(F.lit("first"), "source", F.col("shard").cast("string")), blocks))
        .withColumn("taken", (
            F.col("passes") * F.col("size") + overlap(F.col("first"), F.col("first") + F.col("rest"))
            + overlap(F.lit(0), F.col("first") + F.col("rest") - F.col("shard_size"))).cast("long"))
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, ceiling=CEILING, block=BLOCK, shard=SHARD,
          rows=SHARD_ROWS) -> DataFrame:
    """The rows of `docs` as the mix holds them: a row for each whole time a row is taken, and one with
    its first words for the rest; rows of which nothing is taken go. All columns stay. Each row is
    taken by itself, also without an id or beside others of its id. The texts move once, to their shards."""
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    wanted = F.array_repeat(F.col("size"), whole.cast("int"))
    wanted = F.when(rest > 0, F.concat(wanted, F.array(rest))).otherwise(wanted)
    sizes = sized(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    held = _mix(sizes, weights, share, ceiling, block, shard, rows).where("taken > 0").select(
        "row", "size", F.explode(wanted).alias("words"))
    part = held.where(F.col("words") < F.col("size")).withColumn("row", F.col("row").withField(
        "text", _first_words("row.text", "words")))
    return held.where(F.col("words") == F.col("size")).unionByName(part).select("row.*")


@F.pandas_udf(StringType())
def _first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """A text up to the end of its n-th word."""


    word = re.compile(r"[^\x20\x09-\x0D]+")
    out = []
    for text, n in zip(texts, counts):
        end = 0
        for k, found in enumerate(word.finditer(text or ""), 1):
            end = found.end()
            if k >= n:
                break
        out.append((text or "")[:end])
    return pd.Series(out)

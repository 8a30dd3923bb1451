"""What the national catalogues contain: reference distributions and most frequent names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelytics.constants import (
    ARTIST_FACTOR,
    ARTIST_MIN_LENGTH,
    MAX_NAMES,
    VENUE_FACTOR,
    VENUE_MIN_LENGTH,
    WHITESPACE,
)
from duelytics.dictionaries import Dictionary
from duelytics.functions.matching import names_in_texts
from duelytics.functions.numeric import round_even
from duelytics.functions.ranking import most_frequent
from duelytics.functions.text import clean_text, found_keyword_pattern
from duelytics.operators.metrics import ratio
from duelytics.session import stored


def reference_counts(df: DataFrame, columns: Mapping[str, tuple[str, Dictionary]]) -> DataFrame:
    """(dict, category, rank, hits): catalogue rows whose text mentions each category.

    `columns` maps a column to the name of a dictionary and the dictionary.  All categories of all
    columns are counted in one pass; a row may count for several.  Without rows all have 0.
    """
    texts = df.select(*[clean_text(F.col(column)).alias(column) for column in columns])
    cells = [
        (column, name, category, rank, keywords)
        for column, (name, dictionary) in columns.items()
        for rank, (category, keywords) in enumerate(dictionary.items())
    ]
    counts = texts.agg(
        *[
            F.count_if(mentions_any(column, keywords)).alias(f"c{i}")
            for i, (column, *_, keywords) in enumerate(cells)
        ]
    )
    rows = [
        F.struct(
            F.lit(name).alias("dict"),
            F.lit(category).alias("category"),
            F.lit(rank).alias("rank"),
            F.col(f"c{i}").alias("hits"),
        )
        for i, (_, name, category, rank, _) in enumerate(cells)
    ]
    return counts.select(F.inline(F.array(*rows)))


def mentions_any(column: str, keywords: Sequence[str]) -> Column:
    """Whether a text holds one of the keywords as whole words.  Each has its own pattern that looks for its letters and,
    where they stand, at what is around them; it is tried only on texts that have them as a plain substring, which is
    far cheaper to see."""
    return reduce(
        lambda a, b: a | b,
        [F.contains(F.col(column), F.lit(k)) & F.rlike(column, F.lit(found_keyword_pattern(k))) for k in keywords],
    )


def distribution(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hits → percent of all hits of the dictionary, one decimal; all zero when there are none.

    The window runs over categories, of which there are a few per dictionary.
    """
    total = F.sum("hits").over(W.partitionBy(*keys, "dict"))
    share = ratio(F.col("hits"), F.greatest(total, F.lit(1))) * 100.0
    return counts.select(*keys, "dict", "category", "rank", round_even(share, 1).alias("pct"))


def top_names(
    df: DataFrame, column: str, min_length: int, k: int = MAX_NAMES, split: str | None = None
) -> DataFrame:
    """(name, n): the `k` most frequent names of at least `min_length` characters, in name order
    on ties.  With `split`, a value holds several names."""
    is_text = F.btrim(column, F.lit(WHITESPACE)) != ""  # where `clean_text` gives one, without its lower case
    names = df.filter(is_text).select(clean_text(F.col(column)).alias("v"))
    if split is not None:
        names = names.select(F.explode(F.split("v", split)).alias("v"))
    counts = (
        names.select(F.btrim("v", F.lit(WHITESPACE)).alias("name"))
        .filter(F.length("name") >= min_length)
        .groupBy("name")
        .agg(F.count("*").alias("n"))
    )
    return most_frequent(counts, "n", "name", k)


def top_artists(artworks: DataFrame, k: int = MAX_NAMES) -> DataFrame:
    return top_names(artworks, "Auteur", ARTIST_MIN_LENGTH, k, split="[;,/]")


def top_venues(venues: DataFrame, k: int = MAX_NAMES) -> DataFrame:
    return top_names(venues, "Nom", VENUE_MIN_LENGTH, k)


def coverages(docs: DataFrame, names: Mapping[str, tuple[DataFrame, float]]) -> DataFrame:
    """(model, kind, matched, coverage): how many names of each list occur in a model's texts.

    `names` maps a kind to a result of `top_names` and its factor.  All lists share one pass over the
    texts.  Models without a match are kept with 0.
    """
    listed = None
    for kind, (table, _) in names.items():
        own = table.select(F.lit(kind).alias("kind"), "name")
        listed = own if listed is None else listed.unionByName(own)
    listed = stored(listed, "names")
    found = names_in_texts(docs, listed).groupBy("model", "kind").agg(
        F.count("*").alias("matched")
    )
    sizes = {row["kind"]: row["count"] for row in listed.groupBy("kind").count().collect()}  # a row a list
    fulls = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(float(max(sizes.get(kind, 0) * factor, 1))).alias("full"),
        )
        for kind, (_, factor) in names.items()
    ]
    models = docs.select("model").distinct().select("model", F.inline(F.array(*fulls)))
    share = round_even(F.least(F.col("matched") / F.col("full"), F.lit(100.0)), 1)
    return (
        models.join(found, ["model", "kind"], "left")
        .withColumn("matched", F.coalesce("matched", F.lit(0)))
        .select("model", "kind", "matched", share.alias("coverage"))
    )


def coverage(docs: DataFrame, names: DataFrame, factor: float) -> DataFrame:
    return coverages(docs, {"names": (names, factor)}).drop("kind")


def coverage_artists(docs: DataFrame, names: DataFrame, factor: float = ARTIST_FACTOR) -> DataFrame:
    return coverage(docs, names, factor)


def coverage_venues(docs: DataFrame, names: DataFrame, factor: float = VENUE_FACTOR) -> DataFrame:
    return coverage(docs, names, factor)

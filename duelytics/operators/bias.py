"""Bias scores: the words of the models against the catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duelytics.constants import (
    ARTWORK_SCALE,
    COVERAGE_GRADES,
    GAP_DOMAIN_LIMIT,
    GAP_PAIR_LIMIT,
    SCORE_GRADES,
    VENUE_SCALE,
)
from duelytics.functions.numeric import round_even

# The stored column of each measure, badge labels and thresholds.
STORED = {
    "artworks_score": "joconde_score",
    "artworks_coverage": "joconde_couverture",
    "periods": "joconde_periodes",
    "domains": "joconde_domaines",
    "venues_score": "basilic_score",
    "venues_coverage": "basilic_couverture",
    "regions": "basilic_regions",
    "types": "basilic_types",
    "discriminants": "tfidf_discriminants",
    "communs": "tfidf_communs",
}
MEASURES = ["artworks_score", "artworks_coverage", "venues_score", "venues_coverage"]
MIDDLE_AGES = ("Moyen Âge", 50.0, "Obsession Moyen Âge")
MODERN_ART = ("XXe siècle", 15.0, "Art moderne sous-cité")
HISTORY = (35.0, "Fort biais historique", "Adéquation historique OK")
CAPITAL = ("Île-de-France", 25.0, "Parisiano-centrisme")
STAGE = ("Théâtres & Opéras", 20.0, "Biais spectacle vivant")
REGIONS_HIDDEN = (40.0, "Invisibilisation des régions")
NO_BADGE = "Score standard"

PAIR = "struct<ia:double,ref:double>"


def compare(ia: DataFrame, ref: DataFrame) -> DataFrame:
    """(model, dict, category, rank, ia, ref): both percentages side by side.

    `ref` has one row per dictionary category, so it is safe to broadcast.
    """
    right = F.broadcast(ref.select("dict", "category", F.col("pct").alias("ref")))
    return ia.withColumnRenamed("pct", "ia").join(right, ["dict", "category"])


def mae(pairs: DataFrame) -> DataFrame:
    """(model, dict, mae): mean gap of the rounded percentages, summed exactly in tenths."""
    gap = F.abs(F.col("ia") - F.col("ref")).cast("decimal(10,1)")
    return pairs.groupBy("model", "dict").agg(
        (F.sum(gap).cast("double") / F.count("*")).alias("mae")
    )


def scores(gaps: DataFrame, dicts: Sequence[str], scale: float, name: str) -> DataFrame:
    """Sum of the mean gaps of some dictionaries, scaled, at most 100."""
    per_dict = [
        F.coalesce(F.max(F.when(F.col("dict") == d, F.col("mae"))), F.lit(0.0)) for d in dicts
    ]
    total = sum(per_dict[1:], per_dict[0])
    score = round_even(F.least(total * F.lit(scale), F.lit(100.0)), 1)
    return gaps.groupBy("model").agg(score.alias(name))


def score_artworks(gaps: DataFrame, scale: float = ARTWORK_SCALE) -> DataFrame:
    return scores(gaps, ["periods", "domains"], scale, "artworks_score")


def score_venues(gaps: DataFrame, scale: float = VENUE_SCALE) -> DataFrame:
    return scores(gaps, ["regions", "types"], scale, "venues_score")


def category_map(name: str, value: Column) -> Column:
    """Map category → value in dictionary order, from the rows of one dictionary."""
    rows = F.collect_list(F.when(F.col("dict") == name, F.struct("rank", "category", value)))
    entries = F.transform(F.array_sort(rows), lambda r: F.struct(r["category"], r["v"]))
    return F.map_from_entries(entries).alias(name)


def pair_value() -> Column:
    return F.struct("ia", "ref").alias("v")


def artworks_report(pairs: DataFrame, coverages: DataFrame) -> DataFrame:
    """Score, coverage, period pairs and domain gaps per model."""
    gap = round_even(F.col("ia") - F.col("ref"), 1).alias("v")
    maps = pairs.groupBy("model").agg(
        category_map("periods", pair_value()), category_map("domains", gap)
    )
    return join_report(maps, score_artworks(mae(pairs)), coverages, "artworks_coverage")


def venues_report(pairs: DataFrame, coverages: DataFrame) -> DataFrame:
    """Score, coverage, region pairs and type pairs per model."""
    maps = pairs.groupBy("model").agg(
        category_map("regions", pair_value()), category_map("types", pair_value())
    )
    return join_report(maps, score_venues(mae(pairs)), coverages, "venues_coverage")


def join_report(maps: DataFrame, score: DataFrame, cover: DataFrame, name: str) -> DataFrame:
    cover = cover.select("model", F.col("coverage").alias(name))
    return maps.join(score, "model").join(cover, "model", "left").fillna(0.0, subset=[name])


def bias_scores(artworks: DataFrame, venues: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per model with maps and arrays; `encode_scores` gives the stored form."""
    return artworks.join(venues, "model").join(terms, "model", "left")


def encode_scores(rows: DataFrame) -> DataFrame:
    """The stored form: distributions and term lists as JSON text, the rest as it is."""
    nested = {"periods", "domains", "regions", "types", "discriminants", "communs"}
    return rows.select(
        "model",
        *[
            (F.to_json(name) if name in nested else F.col(name)).alias(stored)
            for name, stored in STORED.items()
        ],
    )


def decode_scores(stored: DataFrame) -> DataFrame:
    """Back from JSON text; missing text gives empty maps and lists, missing measures 0."""
    types = {
        "periods": f"map<string,{PAIR}>",
        "regions": f"map<string,{PAIR}>",
        "types": f"map<string,{PAIR}>",
        "domains": "map<string,double>",
        "discriminants": "array<string>",
        "communs": "array<string>",
    }

    def read(name: str) -> Column:
        column = F.col(STORED[name])
        if name in MEASURES:
            return F.coalesce(column, F.lit(0.0))
        empty = F.lit("[]" if types[name].startswith("array") else "{}")
        text = F.coalesce(F.nullif(column, F.lit("")), empty)
        return F.from_json(text, types[name])

    return stored.select("model", *[read(n).alias(n) for n in STORED])


def labels(*candidates: Column) -> Column:
    return F.array_compact(F.array(*candidates))


def bias_badges(rows: DataFrame) -> DataFrame:
    """Two badge lists per model; a category that is missing counts as 0 percent."""

    def ia(column: str, category: str) -> Column:
        return F.coalesce(F.try_element_at(column, F.lit(category))["ia"], F.lit(0.0))

    def earned(test: Column, label: str) -> Column:
        return F.when(test, F.lit(label))

    artworks = labels(
        earned(ia("periods", MIDDLE_AGES[0]) > MIDDLE_AGES[1], MIDDLE_AGES[2]),
        earned(ia("periods", MODERN_ART[0]) < MODERN_ART[1], MODERN_ART[2]),
        F.when(F.col("artworks_score") >= HISTORY[0], F.lit(HISTORY[1])).otherwise(
            F.lit(HISTORY[2])
        ),
    )
    venues = labels(
        earned(ia("regions", CAPITAL[0]) > CAPITAL[1], CAPITAL[2]),
        earned(ia("types", STAGE[0]) > STAGE[1], STAGE[2]),
        earned(F.col("venues_score") >= REGIONS_HIDDEN[0], REGIONS_HIDDEN[1]),
    )
    standard = F.array(F.lit(NO_BADGE))
    return rows.withColumns(
        {
            "artworks_badges": artworks,
            "venues_badges": F.when(F.size(venues) > 0, venues).otherwise(standard),
        }
    )


def bias_rows(stored: DataFrame) -> DataFrame:
    """Display record per model: decoded scores with defaults, and badges."""
    return stored.transform(decode_scores).transform(bias_badges)


def bias_means(rows: DataFrame) -> DataFrame:
    """One row: the mean of each measure over the models, zeros without models."""
    return rows.agg(
        *[
            F.coalesce(
                round_even(exact_mean(F.col(m)), 2), F.lit(0.0)
            ).alias(m)
            for m in MEASURES
        ]
    )


def exact_mean(x: Column) -> Column:
    return F.try_divide(F.sum(x.cast("decimal(12,1)")).cast("double"), F.count(x).cast("double"))


def bias_deltas(rows: DataFrame) -> DataFrame:
    """Distance of every model from the means."""
    means = bias_means(rows).select(F.struct(*MEASURES)).scalar()
    with_means = rows.select("model", *MEASURES).withColumn("m", means)
    return with_means.select(
        "model", *[(F.col(m) - F.col(f"m.{m}")).alias(f"{m}_delta") for m in MEASURES]
    )


def grade(value: Column, coverage: bool) -> Column:
    """High is good for a coverage, low is good for a score."""
    good, fair = COVERAGE_GRADES if coverage else SCORE_GRADES
    is_good, is_fair = (
        (value >= good, value >= fair) if coverage else (value <= good, value <= fair)
    )
    return F.when(is_good, F.lit("green")).when(is_fair, F.lit("amber")).otherwise(F.lit("red"))


def bias_grades(rows: DataFrame) -> DataFrame:
    return rows.select(
        "model", *[grade(F.col(m), m.endswith("coverage")).alias(f"{m}_grade") for m in MEASURES]
    )


def gap_class(gap: Column, limit: float) -> Column:
    return (
        F.when(gap > limit, F.lit("over"))
        .when(gap < -limit, F.lit("under"))
        .otherwise(F.lit("neutral"))
    )


def gap_classes(pairs: DataFrame) -> DataFrame:
    """(model, dict, category, gap, class): domains have the wider neutral band."""
    gap = round_even(F.col("ia") - F.col("ref"), 1)
    wide = gap_class(F.col("gap"), GAP_DOMAIN_LIMIT)
    narrow = gap_class(F.col("gap"), GAP_PAIR_LIMIT)
    return pairs.select("model", "dict", "category", gap.alias("gap")).withColumn(
        "class", F.when(F.col("dict") == "domains", wide).otherwise(narrow)
    )

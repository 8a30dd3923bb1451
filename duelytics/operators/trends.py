"""Topics of the French duels and monthly trends, per family and version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelytics.functions.numeric import round_even
from duelytics.operators.appearances import appearances, both_levels, count_first
from duelytics.operators.metrics import MODEL, TOKENS, ratio


def topic_pairs(conv: DataFrame, n: int = 50, language: str = "fr") -> DataFrame:
    """The `n` most frequent (category, keyword) pairs of each model.

    Pairs are counted before they are ranked, and the ranking keeps `n` rows per model on each
    partition before the shuffle.
    """
    french = conv.filter(F.array_contains("languages", language))
    pairs = (
        appearances(french, carry=["categories", "keywords"])
        .withColumn("category", F.explode("categories"))
        .withColumn("keyword", F.explode("keywords"))
        .dropna(subset=["category", "keyword"])
        .withColumns({"category": F.lower("category"), "keyword": F.lower("keyword")})
    )
    counts = both_levels(
        pairs,
        {"n": count_first("first_in_family")},
        {"n": count_first("first_in_version")},
        keys=["category", "keyword"],
    ).filter(F.col("n") > 0)
    order = W.partitionBy(*MODEL).orderBy(F.desc("n"), "category", "keyword")
    return (
        counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    )


def top_categories(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The pairs that belong to the `k` heaviest categories of their model."""
    order = W.partitionBy(*MODEL).orderBy(F.desc("total"), "category")
    best = (
        pairs.groupBy(*MODEL, "category")
        .agg(F.sum("n").alias("total"))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= k)
    )
    return pairs.join(best, [*MODEL, "category"], "left_semi")


def month_of(time: str = "timestamp") -> Column:
    return F.date_format(time, "yyyy-MM")


def tokens_monthly(conv: DataFrame) -> DataFrame:
    """Tokens per month and their share of the model's total; models without tokens drop out."""
    rows = appearances(conv, TOKENS, ["timestamp"]).withColumn("month", month_of())
    own = {"tokens": F.coalesce(F.sum("tokens"), F.lit(0))}
    months = both_levels(rows, own, own, keys=["month"])
    total = F.sum("tokens").over(W.partitionBy(*MODEL))
    share = ratio(F.col("tokens"), F.nullif(F.col("total"), F.lit(0))) * 100.0
    return (
        months.withColumn("total", total)
        .withColumn("frequency", share)
        .filter(F.col("frequency").isNotNull())
        .drop("total")
    )


def winrate_monthly(votes: DataFrame) -> DataFrame:
    """Mean score per month in percent; a model that meets itself scores on both sides."""
    half = F.lit(0.5).cast("double")
    score = (
        F.when(F.col("both_equal"), half)
        .when(F.col("chosen_base_model") == F.col("family"), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    carry = ["timestamp", "chosen_base_model", "both_equal"]
    rows = appearances(votes, carry=carry).withColumn("month", month_of())
    parts = {"score": F.sum(score), "n": F.count("*")}
    months = both_levels(rows, parts, parts, keys=["month"])
    rate = round_even(ratio(F.col("score"), F.col("n")) * 100.0, 2)
    return months.select(*MODEL, "month", rate.alias("winrate"))


def trend(frequency: DataFrame, wins: DataFrame) -> DataFrame:
    return frequency.join(wins, [*MODEL, "month"])

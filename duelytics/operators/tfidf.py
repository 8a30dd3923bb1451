"""TF-IDF over one bag of uni- and bigrams per model, as a sparse long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from duelytics.constants import (
    TFIDF_MAX_DF,
    TFIDF_MAX_FEATURES,
    TFIDF_MIN_DF,
    TOP_COMMUNS,
    TOP_DISCRIMINANTS,
)
from duelytics.functions.ranking import most_frequent
from duelytics.functions.terms import BUCKETS, counts_in_buckets, fitting_buckets, spaced
from duelytics.functions.text import WORD
from duelytics.session import stored


def term_counts(docs: DataFrame) -> DataFrame:
    """(model, term, tf): words of two characters or more and pairs of neighbours.

    Terms are counted on the map side before they are shuffled on (model, term).  The filter on
    null states what the joins on `term` would infer, so that all uses share one shuffle.
    """
    words = F.regexp_extract_all("text", F.lit(WORD + "{2,}"), F.lit(0))
    w = F.col("words")
    pairs = F.when(
        F.size(w) > 1,
        F.zip_with(
            F.slice(w, F.lit(1), F.size(w) - 1),
            F.slice(w, F.lit(2), F.size(w) - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return (
        docs.select("model", words.alias("words"))
        .select("model", F.explode(F.concat(w, pairs)).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("model", "term")
        .agg(F.count("*").alias("tf"))
    )


def frequent_term_counts(
    docs: DataFrame,
    max_features: int = TFIDF_MAX_FEATURES,
    min_df: int = TFIDF_MIN_DF,
    max_df: float = TFIDF_MAX_DF,
) -> DataFrame:
    """(model, term, tf), stored: the rows of `term_counts` for every term that the vocabulary may hold.

    The hashes of all terms tell which fit the limits on models and reach the total of the `max_features`-th of those;
    only terms that share a bucket with one of them are counted as strings.  If fewer terms fit, every term is
    counted.  The texts are cut at what is no word once and stored.
    """
    texts = stored(spaced(docs), "texts")
    models = docs.agg(F.count_distinct("model")).first()[0]
    fitting = stored(fitting_buckets(texts, max_features, min_df, max_df * models), "buckets")
    cut = None
    if fitting.count() >= max_features:
        cut = most_frequent(fitting, "total", "bucket", max_features).agg(F.min("total")).first()[0]
    if cut is not None:
        counts = stored(counts_in_buckets(texts, fitting.filter(F.col("total") >= cut)), "terms")
        terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        fit = (F.col("df") >= min_df) & (F.col("df") <= max_df * models)
        if terms.filter(fit & (F.col("total") >= cut)).count() >= max_features:
            return counts
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    return stored(counts_in_buckets(texts, every), "terms")


def tfidf_vocabulary(
    docs: DataFrame,
    counts: DataFrame | None = None,
    max_features: int = TFIDF_MAX_FEATURES,
    min_df: int = TFIDF_MIN_DF,
    max_df: float = TFIDF_MAX_DF,
) -> DataFrame:
    """(term, df, total, models): the most frequent terms that occur in neither too few nor too
    many models; `models` is the number of models."""
    if counts is None:
        counts = frequent_term_counts(docs, max_features, min_df, max_df)
    models = docs.agg(F.count_distinct("model").alias("n")).scalar()
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = terms.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * models))
    return most_frequent(kept, "total", "term", max_features).withColumn("models", models)


def tfidf_weights(docs: DataFrame, **limits) -> DataFrame:
    """(model, term, tf, df, weight) for the vocabulary; each model's weights have norm 1.

    The vocabulary is capped at `max_features`, so it can be broadcast.
    """
    counts = frequent_term_counts(docs, **limits)
    vocabulary = tfidf_vocabulary(docs, counts, **limits)
    smooth = F.log((F.col("models") + 1).cast("double") / (F.col("df") + 1)) + 1.0
    raw = counts.join(F.broadcast(vocabulary), "term").withColumn("raw", F.col("tf") * smooth)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("model")))
    return raw.select("model", "term", "tf", "df", (F.col("raw") / norm).alias("weight"))


def discriminants(
    weights: DataFrame, keywords: Sequence[str], n: int = TOP_DISCRIMINANTS
) -> DataFrame:
    """(model, term, weight, rank): the heaviest terms that are dictionary keywords."""
    order = W.partitionBy("model").orderBy(F.desc("weight"), "term")
    return (
        weights.filter(F.col("term").isin(list(keywords)))
        .select("model", "term", "weight")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def communs(
    docs: DataFrame, weights: DataFrame, keywords: Sequence[str], n: int = TOP_COMMUNS
) -> DataFrame:
    """(model, term, rank): keywords of the vocabulary the model never uses, in name order.

    Every term of the vocabulary has a weight in some model, so the vocabulary's keywords are
    read from `weights`; the candidates are the literal keywords on each model's row.
    """
    used = weights.filter(F.col("term").isin(list(keywords))).select("model", "term")
    each = F.explode(F.array(*[F.lit(k) for k in keywords]))
    wanted = docs.select("model").distinct().select("model", each.alias("term"))
    unused = wanted.join(used.select("term").distinct(), "term", "left_semi").join(
        used, ["model", "term"], "left_anti"
    )
    order = W.partitionBy("model").orderBy("term")
    return unused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def tfidf_top_terms(docs: DataFrame, keywords: Sequence[str], **limits) -> DataFrame:
    """(model, discriminants, communs): two short ordered lists per model.

    Only the weights of the keywords matter from here on, at most models × keywords rows; they
    are stored, so the texts are counted once for both lists.
    """
    weights = tfidf_weights(docs, **limits)
    kept = stored(weights.filter(F.col("term").isin(list(keywords))))

    def listed(terms: DataFrame, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))["term"]
        return terms.groupBy("model").agg(ordered.alias(name))

    empty = F.array().cast("array<string>")
    return (
        docs.select("model")
        .distinct()
        .join(listed(discriminants(kept, keywords), "discriminants"), "model", "left")
        .join(listed(communs(docs, kept, keywords), "communs"), "model", "left")
        .select(
            "model",
            F.coalesce("discriminants", empty).alias("discriminants"),
            F.coalesce("communs", empty).alias("communs"),
        )
    )

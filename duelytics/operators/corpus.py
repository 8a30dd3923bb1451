"""From cultural duels to per-model documents and keyword counts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duelytics.constants import CULTURAL_STEMS, MAX_DOCS, SAMPLE_SEED, WHITESPACE
from duelytics.dictionaries import DictionarySet
from duelytics.functions.matching import keyword_hits
from duelytics.functions.ranking import first_per_group
from duelytics.functions.text import conversation_text, mentions, stem_pattern


def cultural_filter(df: DataFrame, stems: Sequence[str] = CULTURAL_STEMS) -> DataFrame:
    """Duels whose categories or keywords contain one of the stems, in any case."""
    pattern = stem_pattern(stems)
    return df.filter(
        mentions(F.col("categories"), pattern) | mentions(F.col("keywords"), pattern)
    )


def conv_text(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"text_{s}": conversation_text(F.col(f"conversation_{s}")) for s in ("a", "b")}
    )


def model_docs(df: DataFrame, doc_id: str) -> DataFrame:
    """(model, doc_id, side, text): the transcript of each side belongs to that side's model."""
    sides = [
        F.struct(
            F.col(f"base_model_{s}").alias("model"),
            F.lit(s).alias("side"),
            F.col(f"text_{s}").alias("text"),
        )
        for s in ("a", "b")
    ]
    return (
        conv_text(df)
        .select(F.col(doc_id).alias("doc_id"), F.inline(F.array(*sides)))
        .filter(F.btrim("text", F.lit(WHITESPACE)) != "")
    )


def model_corpus(docs: DataFrame) -> DataFrame:
    """(model, docs, characters): how much text each model's documents hold together."""
    return docs.groupBy("model").agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("characters")
    )


def sample_docs(
    docs: DataFrame,
    n: int = MAX_DOCS,
    seed: int = SAMPLE_SEED,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """At most `n` documents per model, the same ones whatever the partitioning.

    Only the keys are ranked.  The texts of the chosen ones come back by a semi-join.
    """
    tag = F.md5(F.concat_ws("", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    ids = docs.select("model", *keys, tag.alias("_tag"))
    chosen = first_per_group(ids, ["model"], "_tag", keys, n)
    return docs.join(chosen.drop("_tag"), ["model", *keys], "left_semi")


def keyword_counts(docs: DataFrame, dictionaries: DictionarySet) -> DataFrame:
    """Hits per model, dictionary and category over whole texts; categories without hits give 0.

    One pass over the texts whatever the number of categories.  Texts are counted one by one,
    so the largest model is spread over all tasks.
    """
    return labelled(keyword_hits(docs, keyword_lists(dictionaries)), dictionaries).drop("texts")


def keyword_lists(dictionaries: DictionarySet) -> list[list[str]]:
    return [keywords for categories in dictionaries.values() for keywords in categories.values()]


def label_array(dictionaries: DictionarySet) -> Column:
    """(dict, category, rank, index) of each keyword list, as one constant array."""
    labels = [
        {"dict": name, "category": category, "rank": rank}
        for name, categories in dictionaries.items()
        for rank, category in enumerate(categories)
    ]
    numbered = json.dumps([{**label, "index": i} for i, label in enumerate(labels)])
    kind = "array<struct<dict:string,category:string,rank:int,index:int>>"
    return F.from_json(F.lit(numbered), kind)


def labelled(hits: DataFrame, dictionaries: DictionarySet) -> DataFrame:
    """Dictionary, category and rank of each keyword list instead of its index."""
    label = F.element_at(label_array(dictionaries), F.col("index") + 1)
    return hits.withColumn("label", label).select(
        "model", "label.dict", "label.category", "label.rank", "hits", "texts"
    )

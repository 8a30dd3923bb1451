"""Cultural duels and catalogues → one bias row per model."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelytics.constants import ARTIST_FACTOR, MAX_DOCS, VENUE_FACTOR
from duelytics.dictionaries import CATALOGUE_SIDE, CONVERSATION_SIDE, DictionarySet, keyword_set
from duelytics.operators import bias, catalogue, corpus, tfidf
from duelytics.session import stored, temporary
from duelytics.sources.files import read_artworks, read_parquet, read_venues, write_parquet


def reference(artworks: DataFrame, venues: DataFrame, side: DictionarySet) -> DataFrame:
    """Percentages of all four dictionaries in the catalogues: a few dozen rows."""
    counts = catalogue.reference_counts(
        artworks,
        {
            "Periode_de_creation": ("periods", side["periods"]),
            "Domaine": ("domains", side["domains"]),
        },
    ).unionByName(
        catalogue.reference_counts(
            venues,
            {"Region": ("regions", side["regions"]), "Type_equipement": ("types", side["types"])},
        )
    )
    return catalogue.distribution(counts)


def bias_pairs(
    docs: DataFrame,
    artworks: DataFrame,
    venues: DataFrame,
    conversation: DictionarySet = CONVERSATION_SIDE,
    catalogue_side: DictionarySet = CATALOGUE_SIDE,
) -> DataFrame:
    """Percentages of the models beside those of the catalogues."""
    ia = catalogue.distribution(corpus.keyword_counts(docs, conversation), keys=["model"])
    return bias.compare(ia, reference(artworks, venues, catalogue_side))


def score(
    docs: DataFrame,
    artworks: DataFrame,
    venues: DataFrame,
    conversation: DictionarySet = CONVERSATION_SIDE,
    catalogue_side: DictionarySet = CATALOGUE_SIDE,
    **limits,
) -> DataFrame:
    """Bias row per model, with maps and lists.

    The texts are read by three passes: keyword counts, names, terms.  The percentages feed four
    small aggregations, so they are stored once.
    """
    pairs = stored(bias_pairs(docs, artworks, venues, conversation, catalogue_side))
    names = {
        "artworks": (catalogue.top_artists(artworks), ARTIST_FACTOR),
        "venues": (catalogue.top_venues(venues), VENUE_FACTOR),
    }
    covered = stored(catalogue.coverages(docs, names))
    terms = tfidf.tfidf_top_terms(docs, keyword_set(conversation), **limits)
    return bias.bias_scores(
        bias.artworks_report(pairs, covered.filter(F.col("kind") == "artworks")),
        bias.venues_report(pairs, covered.filter(F.col("kind") == "venues")),
        terms,
    )


def prepare_docs(
    conversations: DataFrame, doc_id: str, max_docs: int | None = None
) -> DataFrame:
    """Cultural duels → documents per model; all of them, or a sample of `max_docs` per model."""
    docs = corpus.model_docs(corpus.cultural_filter(conversations), doc_id)
    if max_docs is None:
        return docs
    return corpus.sample_docs(docs, max_docs, keys=("doc_id", "side"))


def run(
    spark: SparkSession,
    bias_conv: str,
    artworks: str,
    venues: str,
    output: str,
    doc_id: str = "conversation_pair_id",
    max_docs: int | None = None,
    multi_line: bool = False,
    dictionaries: tuple[DictionarySet, DictionarySet] = (CONVERSATION_SIDE, CATALOGUE_SIDE),
) -> None:
    """Score every model and write the stored form.  `doc_id` is a unique key of the duels.

    The transcripts are read once (twice with a sample) and their documents stored; these are read
    for keyword counts, for names, for terms and three times for the models alone.  Each catalogue
    is read twice: for its distributions and for its most frequent names; with `multi_line` its records
    are cut once and stored, and this is what is read.
    """
    with temporary(spark):
        docs = stored(prepare_docs(read_parquet(spark, bias_conv), doc_id, max_docs), "docs")
        tables = read_artworks(spark, artworks, multi_line), read_venues(spark, venues, multi_line)
        write_parquet(bias.encode_scores(score(docs, *tables, *dictionaries)), output)


if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("bias_conv", "artworks", "venues", "output"):
        parser.add_argument(name)
    parser.add_argument("--doc-id", default="conversation_pair_id")
    parser.add_argument("--max-docs", type=int, help=f"a sample per model, such as {MAX_DOCS}")
    parser.add_argument("--multi-line", action="store_true", help="line breaks in quoted fields")
    args = parser.parse_args()
    run(
        SparkSession.builder.getOrCreate(),
        args.bias_conv,
        args.artworks,
        args.venues,
        args.output,
        args.doc_id,
        args.max_docs,
        args.multi_line,
    )

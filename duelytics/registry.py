"""One query per operator over the whole derived tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelytics import derived
from duelytics.derived import CHECK_CATALOGUE, CHECK_DICTIONARIES
from duelytics.dictionaries import CONVERSATION_SIDE, keyword_set
from duelytics.functions.naming import family_of, family_stem, version_of
from duelytics.functions.text import clean_text, keyword_pattern, parse_transcript
from duelytics.operators import (
    audience, bias, catalogue, cleaning, corpus, explorer, metrics, tfidf, trends,
)
from duelytics.plans import bias_job, cleaning_job
from duelytics.plans.bias_job import bias_pairs, reference, score
from duelytics.session import new_folder, stored
from duelytics.sources import arena, files

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries; the checks use the same ones.
SAMPLE = 30
EXPLORED = {"m1": "gpt", "v1": "4.1-mini", "m2": "claude", "v2": "4-5-sonnet"}
CATEGORIES = ["1-URGENT", "5-LOW"]
DETAIL_ID = 100


class Tables:
    """The tables the queries start from, each built lazily for one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return getattr(derived, name)(self.spark, self.folder)

    @property
    def duels(self) -> DataFrame:
        return self.raw("duels")

    @cached_property
    def names(self) -> DataFrame:
        """Chosen names are always one of the two."""
        return cleaning.name_table(self.raw("duel_names"))

    @property
    def conv(self) -> DataFrame:
        return cleaning.build_conv(self.duels, self.names)

    @property
    def votes(self) -> DataFrame:
        return cleaning.build_votes(self.duels, self.names)

    @property
    def react(self) -> DataFrame:
        return cleaning.build_react(self.raw("reactions"), self.names)

    @property
    def arena(self) -> DataFrame:
        """Written in the order of days and numbered as it is read."""
        return files.read_arena(self.spark, self.arena_path)

    @cached_property
    def arena_path(self) -> str:
        day = F.coalesce(F.to_date("timestamp"), F.to_date(F.lit("1970-01-01")))
        cut = F.substring(F.md5(F.col("duel_id").cast("string")), 1, 3)
        path = scratch(self)
        files.write_parquet(
            cleaning.build_arena(self.duels, "duel_id", self.names).orderBy(day, cut, "duel_id"), path
        )
        arena.write_offsets(self.spark, path)
        return path

    @property
    def arena_rows(self) -> DataFrame:
        """The arena without its row id, for operators that do not use it."""
        return cleaning.arena_duels(self.duels, self.names)

    @property
    def corpus(self) -> DataFrame:
        return self.raw("corpus")

    @cached_property
    def pairs(self) -> DataFrame:
        """A few hundred rows from all texts and catalogues; reports and measures use them more than once."""
        return stored(bias_pairs(
            self.corpus, self.raw("artworks"), self.raw("venues"),
            CHECK_DICTIONARIES, CHECK_CATALOGUE,
        ))

    @property
    def artists(self) -> DataFrame:
        return catalogue.top_artists(self.raw("artworks"))

    @property
    def places(self) -> DataFrame:
        return catalogue.top_venues(self.raw("venues"))

    @property
    def scored(self) -> DataFrame:
        return score(
            self.corpus, self.raw("artworks"), self.raw("venues"),
            CHECK_DICTIONARIES, CHECK_CATALOGUE,
        )

    @property
    def measures(self) -> DataFrame:
        """The four measures per model, without maps and term lists."""
        gaps = bias.mae(self.pairs)
        covered = {
            "artworks_coverage": catalogue.coverage_artists(self.corpus, self.artists),
            "venues_coverage": catalogue.coverage_venues(self.corpus, self.places),
        }
        out = bias.score_artworks(gaps).join(bias.score_venues(gaps), "model")
        for name, table in covered.items():
            out = out.join(table.select("model", F.col("coverage").alias(name)), "model")
        return out


def long_maps(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Map columns of a report as rows (model, dict, category, ia, ref)."""
    out = None
    for name in names:
        entries = rows.select("model", *keep, F.explode(name).alias("category", "v"))
        is_pair = name != "domains"
        part = entries.select(
            "model",
            *keep,
            F.lit(name).alias("dict"),
            "category",
            (F.col("v.ia") if is_pair else F.col("v")).alias("ia"),
            (F.col("v.ref") if is_pair else F.lit(None).cast("double")).alias("ref"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def names(t: Tables) -> DataFrame:
    return t.duels.select("duel_id", F.col("model_a_name").alias("name"))


def arena_keys(df: DataFrame) -> DataFrame:
    return df.select(
        "duel_id", "base_model_a", "version_a", "base_model_b", "version_b",
        "chosen_base_model", "both_equal", "selected_category", "conv_turns",
    )


def bench(t: Tables) -> DataFrame:
    return metrics.benchmarks(t.react, t.conv)


def reaction_part(t: Tables, *columns: str) -> DataFrame:
    return metrics.reaction_metrics(t.react).select("family", "version", *columns)


def totals(t: Tables, *parts: str) -> DataFrame:
    return metrics.duel_totals(t.conv, list(parts))


def prices(t: Tables) -> DataFrame:
    return metrics.price_per_token(metrics.model_versions(t.conv), t.raw("prices"))


def sketched(t: Tables) -> DataFrame:
    """The exact audience, and whether the estimate from stored monthly sketches is as close as stated."""
    path = scratch(t)
    files.write_parquet(audience.sketches(t.conv), path)
    near = audience.estimated(files.read_parquet(t.spark, path))
    off = F.abs(F.col("estimate") - F.col("visitors"))
    return metrics.audience(t.conv).join(near, metrics.MODEL, "left").select(
        *metrics.MODEL, "visitors",
        F.coalesce(off <= F.ceil(audience.MOST_OFF * F.col("visitors")), F.lit(False)).alias("close"),
    )


def stem(t: Tables) -> DataFrame:
    return names(t).withColumn("stem", family_stem(F.col("name")))


def rule_out(t: Tables) -> DataFrame:
    return names(t).withColumn("family", F.btrim(family_of(F.col("name")), F.lit("-")))


def rounded(df: DataFrame, column: str, digits: int = 9) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def scratch(t: Tables) -> str:
    """A new folder beside the checkpoints, for queries that write and read back."""
    return new_folder(t.spark, "registry")


def source_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    def written(t: Tables) -> DataFrame:
        path = f"{scratch(t)}/conv.parquet"
        files.write_parquet(t.conv, path)
        return files.read_parquet(t.spark, path)

    def cleaned(t: Tables) -> DataFrame:
        folder = scratch(t)
        files.write_parquet(t.duels, f"{folder}/raw/votes.parquet")
        files.write_parquet(t.duels, f"{folder}/raw/conversations.parquet")
        files.write_parquet(t.raw("reactions"), f"{folder}/raw/reactions.parquet")
        cleaning_job.run(t.spark, f"{folder}/raw", f"{folder}/clean", "duel_id", "duel_id")
        _, votes, _ = files.read_cleaned(t.spark, f"{folder}/clean")
        return votes

    def artworks(t: Tables) -> DataFrame:
        path = scratch(t)
        extra = {name: F.lit("x") for name in ("Region", "Nom_officiel_musee", "unused")}
        files.write_text_table(t.raw("artworks").withColumns(extra), path, "|")
        return files.read_artworks(t.spark, path, multi_line=True)

    def venues(t: Tables) -> DataFrame:
        path = scratch(t)
        columns = {
            "Type équipement ou lieu": F.col("Type_equipement"), "Domaine": F.lit("d"),
            "Région": F.col("Region"), "Département": F.lit("75"),
            "libelle_geographique": F.lit("Paris"), "unused": F.lit("x"),
        }
        raw = t.raw("venues").select("Nom", *[c.alias(n) for n, c in columns.items()])
        files.write_text_table(raw, path, ";")
        return files.read_venues(t.spark, path, multi_line=True)

    def guarded(t: Tables) -> DataFrame:
        there = derived.table(t.spark, t.folder, "conversations")
        found, missing = (
            files.read_or_empty(t.spark, f"{t.folder}/{name}.parquet", there.schema)
            for name in ("conversations", "no_such_table")
        )
        return found.unionByName(missing)

    def listed_prices(t: Tables) -> DataFrame:
        path = scratch(t)
        files.write_prices(t.raw("prices"), path)
        return files.read_prices(t.spark, path)

    def all_parquet(t: Tables) -> DataFrame:
        return files.read_parquet(t.spark, f"{t.folder}/events.parquet")

    def whole_bias_job(t: Tables) -> DataFrame:
        """Transcripts, cultural filter, documents, scores, stored table and back."""
        folder = scratch(t)
        duels = cleaning.build_bias_conv(t.raw("text_duels"), "duel_id")
        files.write_parquet(duels, f"{folder}/bias_conv.parquet")
        extra = {name: F.lit("x") for name in ("Region", "Nom_officiel_musee")}
        files.write_text_table(t.raw("artworks").withColumns(extra), f"{folder}/art", "|")
        raw = t.raw("venues").select(
            "Nom", F.col("Type_equipement").alias("Type équipement ou lieu"), F.lit("d").alias("Domaine"),
            F.col("Region").alias("Région"), F.lit("75").alias("Département"),
            F.lit("Paris").alias("libelle_geographique"),
        )
        files.write_text_table(raw, f"{folder}/venues", ";")
        bias_job.run(
            t.spark, f"{folder}/bias_conv.parquet", f"{folder}/art", f"{folder}/venues",
            f"{folder}/scores", "duel_id", multi_line=True,
            dictionaries=(CHECK_DICTIONARIES, CHECK_CATALOGUE),
        )
        return files.read_scores(t.spark, f"{folder}/scores")

    return {
        "src_parquet": all_parquet,
        "src_prices": listed_prices,
        "bias_job": whole_bias_job,
        "src_clean": lambda t: cleaned(t).select(
            "base_model_a", "version_b", "chosen_base_model", "both_equal", "conv_turns"
        ),
        "src_artworks": lambda t: artworks(t).select("Auteur", "Region"),
        "src_venues": lambda t: venues(t).select("Nom", "Type_equipement", "Region", "Commune"),
        "sink_parquet": lambda t: written(t).select(
            "duel_id", "visitor_id", "base_model_a", "version_a", "timestamp", "conv_turns"
        ),
        "src_guard": guarded,
    }


def cleaning_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    def numbered(t: Tables) -> DataFrame:
        path = scratch(t)
        key = F.substring(F.md5(F.col("duel_id").cast("string")), 1, 3)
        files.write_parquet(
            t.duels.select("duel_id", "timestamp").orderBy(F.to_date("timestamp"), key, "duel_id"), path
        )
        return cleaning.arena_row_id(files.read_parquet(t.spark, path))

    return {
        "clean_junk_names": lambda t: cleaning.drop_junk_names(t.duels).select(
            "duel_id", "model_a_name", "model_b_name"
        ),
        "clean_bad_names": lambda t: t.duels.transform(cleaning.drop_junk_names)
        .transform(cleaning.drop_bad_names)
        .select("duel_id", "model_a_name", "model_b_name"),
        "clean_visitor": lambda t: cleaning.fill_visitor(t.duels).select("duel_id", "visitor_id"),
        "clean_turns": lambda t: cleaning.keep_started(t.duels).select("duel_id", "conv_turns"),
        "model_version": lambda t: names(t).withColumn(
            "version", F.btrim(version_of(F.col("name")), F.lit("-"))
        ),
        "model_family": stem,
        "family_corrections": rule_out,
        "family_required": lambda t: cleaning.require_families(
            cleaning.add_families(t.duels)
        ).select("duel_id", "base_model_a", "base_model_b"),
        "winner_normalize": lambda t: cleaning.normalize_winner(t.duels).select(
            "duel_id", "chosen_model_name", "chosen_base_model", "chosen_version"
        ),
        "reaction_side": lambda t: t.raw("reactions")
        .transform(cleaning.normalize_models, t.names)
        .transform(cleaning.reaction_side)
        .select("id", "msg_rank", "model_pos", "model", "version"),
        "prune_reactions": lambda t: cleaning.prune_reactions(t.raw("reactions")),
        "prune_conversations": lambda t: cleaning.prune_conversations(t.duels).select(
            "duel_id", "visitor_id", "model_a_name", "conv_turns", "mode", "opening_msg"
        ),
        "prune_votes": lambda t: cleaning.prune_votes(t.duels).select(
            "model_a_name", "model_b_name", "chosen_model_name", "session_hash", "conv_turns"
        ),
        "arena_project": lambda t: cleaning.arena_project(t.arena_rows, ["duel_id"]).select(
            "duel_id", "base_model_a", "version_a", "chosen_version", "conv_useful_a",
            "conv_superficial_b", "opening_msg",
        ),
        "arena_row_id": numbered,
        "bias_project": lambda t: cleaning.bias_project(t.arena_rows, ["duel_id"]).select(
            "duel_id", "base_model_a", "base_model_b", "visitor_id", "timestamp", "opening_msg"
        ),
        "build_react": lambda t: t.react,
        "build_conv": lambda t: t.conv.select(
            "duel_id", "visitor_id", "base_model_a", "version_a", "base_model_b", "version_b",
            "conv_turns", "total_conv_a_kwh", "total_conv_b_kwh", "total_conv_b_output_tokens",
        ),
        "build_votes": lambda t: t.votes.select(
            "base_model_a", "version_a", "base_model_b", "version_b", "chosen_base_model",
            "chosen_version", "both_equal", "timestamp",
        ),
        "build_arena": lambda t: t.arena.select(
            "arena_id", "duel_id", "base_model_a", "version_a", "base_model_b", "version_b",
            "chosen_base_model", "both_equal", "selected_category",
        ),
        "build_bias_conv": lambda t: cleaning.build_bias_conv(
            t.raw("text_duels"), "duel_id"
        ).select("duel_id", "base_model_a", "base_model_b", "opening_msg", "visitor_id"),
    }


def metric_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    return {
        "model_structure": lambda t: metrics.model_structure(t.conv),
        "home_kpis": lambda t: metrics.home_kpis(t.conv),
        "conv_count": lambda t: metrics.conv_count(t.conv),
        "vote_count": lambda t: metrics.conv_count(t.votes),
        "param_size": lambda t: metrics.param_size(t.conv),
        "audience": lambda t: metrics.audience(t.conv),
        "audience_sketch": sketched,
        "winrate": lambda t: metrics.winrate(t.votes),
        "ranking": lambda t: metrics.ranking(
            metrics.winrate(t.votes), metrics.model_structure(t.conv)
        ),
        "satisfaction": lambda t: reaction_part(t, "satisfaction"),
        "reaction_count": lambda t: reaction_part(t, "reactions"),
        "energy_total": lambda t: metrics.energy(
            totals(t, "kwh", "kwh_first", "kwh_n")
        ).select("family", "version", "kwh_total"),
        "energy_avg": lambda t: metrics.energy(
            totals(t, "kwh", "kwh_first", "kwh_n")
        ).select("family", "version", "kwh_avg"),
        "tokens_total": lambda t: metrics.tokens(
            totals(t, "tokens", "tokens_first", "tokens_n")
        ).select("family", "version", "tokens_total"),
        "tokens_avg": lambda t: metrics.tokens(
            totals(t, "tokens", "tokens_first", "tokens_n")
        ).select("family", "version", "tokens_avg"),
        "carbon": lambda t: metrics.carbon(totals(t, "conversations", "kwh")),
        "price_per_token": prices,
        "estimated_cost": lambda t: metrics.estimated_cost(
            prices(t), totals(t, "tokens", "tokens_first", "tokens_n")
        ),
        "turns_total": lambda t: metrics.turns(
            totals(t, "turns", "turns_sides", "sides")
        ).select("family", "version", "turns_total"),
        "turns_avg": lambda t: metrics.turns(
            totals(t, "turns", "turns_sides", "sides")
        ).select("family", "version", "turns_avg"),
        "pick_rate": lambda t: metrics.pick_rate(totals(t, "picks"), t.conv).drop(
            "pick_rate_delta"
        ),
        "pick_rate_delta": lambda t: metrics.pick_rate(totals(t, "picks"), t.conv).drop(
            "pick_rate"
        ),
        "deep_engagement": lambda t: metrics.deep_engagement(totals(t, "conversations", "deep")),
        "benchmarks_global": bench,
        "model_tag_means": lambda t: reaction_part(t, *[f"{tag}_mean" for tag in metrics.TAGS]),
        "model_badges": lambda t: metrics.badges(
            metrics.reaction_metrics(t.react),
            totals(t, "tokens", "tokens_first", "tokens_n", "turns", "turns_sides", "sides"),
            metrics.winrate(t.votes),
            bench(t),
        ).withColumn("badges", F.array_join("badges", "|")),
        "model_metrics": lambda t: metrics.model_metrics(t.conv, t.votes),
        "topic_pairs": lambda t: trends.topic_pairs(t.conv),
        "topic_top_categories": lambda t: trends.top_categories(trends.topic_pairs(t.conv)),
        "tokens_monthly_share": lambda t: trends.tokens_monthly(t.conv),
        "winrate_monthly": lambda t: trends.winrate_monthly(t.votes),
        "trend_join": lambda t: trends.trend(
            trends.tokens_monthly(t.conv), trends.winrate_monthly(t.votes)
        ),
    }


def corpus_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    def text_duels(t: Tables) -> DataFrame:
        return cleaning.build_bias_conv(t.raw("text_duels"), "duel_id")

    check_words = keyword_set(CHECK_DICTIONARIES)

    def weights(t: Tables) -> DataFrame:
        return tfidf.tfidf_weights(t.corpus)

    return {
        "cultural_filter": lambda t: corpus.cultural_filter(t.raw("text_duels")).select(
            "duel_id", "opening_msg"
        ),
        "conv_text": lambda t: corpus.conv_text(t.raw("text_duels")).select(
            "duel_id", "text_a", "text_b"
        ),
        "model_docs": lambda t: corpus.model_docs(text_duels(t), "duel_id"),
        "sample_docs": lambda t: corpus.sample_docs(t.corpus, SAMPLE),
        "model_corpus": lambda t: corpus.model_corpus(t.corpus),
        "col_normalize": lambda t: t.raw("venues")
        .select("Nom", clean_text(F.col("Nom")).alias("name"))
        .dropna(),
        "keyword_patterns": lambda t: t.corpus.groupBy("model").agg(
            *[
                F.count_if(F.rlike("text", F.lit(keyword_pattern(keywords)))).alias(f"texts_{i}")
                for i, keywords in enumerate(corpus.keyword_lists(CHECK_DICTIONARIES))
            ]
        ),
        "keyword_counts": lambda t: corpus.keyword_counts(t.corpus, CHECK_DICTIONARIES),
        "keyword_dicts": lambda t: corpus.keyword_counts(t.corpus, CONVERSATION_SIDE),
        "cultural_keyword_set": lambda t: tfidf.term_counts(t.corpus).filter(
            F.col("term").isin(check_words)
        ),
        "tfidf_vocabulary": lambda t: tfidf.tfidf_vocabulary(t.corpus),
        "tfidf_weights": lambda t: rounded(weights(t), "weight"),
        "tfidf_discriminants": lambda t: rounded(
            tfidf.discriminants(weights(t), check_words), "weight"
        ),
        "tfidf_communs": lambda t: tfidf.communs(t.corpus, weights(t), check_words),
        "tfidf_top_terms": lambda t: tfidf.tfidf_top_terms(
            t.corpus, check_words
        ).select(
            "model",
            F.array_join("discriminants", "|").alias("discriminants"),
            F.array_join("communs", "|").alias("communs"),
        ),
    }


def bias_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    def counted(column: str, table: str, name: str) -> Callable[[Tables], DataFrame]:
        return lambda t: catalogue.reference_counts(
            t.raw(table), {column: (name, CHECK_CATALOGUE[name])}
        )

    def stored(t: Tables) -> DataFrame:
        return bias.encode_scores(t.scored)

    map_names = ["periods", "domains", "regions", "types"]
    text_columns = ["discriminants", "communs", "artworks_badges", "venues_badges"]

    def artworks(t: Tables) -> DataFrame:
        return bias.artworks_report(t.pairs, catalogue.coverage_artists(t.corpus, t.artists))

    def venues(t: Tables) -> DataFrame:
        return bias.venues_report(t.pairs, catalogue.coverage_venues(t.corpus, t.places))

    def badge_texts(t: Tables) -> DataFrame:
        rows = bias.bias_badges(t.scored)
        return rows.select(
            "model", *[F.array_join(c, "|").alias(c) for c in text_columns[2:]]
        )

    return {
        "ref_periods": counted("Periode_de_creation", "artworks", "periods"),
        "ref_domains": counted("Domaine", "artworks", "domains"),
        "ref_regions": counted("Region", "venues", "regions"),
        "ref_types": counted("Type_equipement", "venues", "types"),
        "pct_distribution": lambda t: reference(
            t.raw("artworks"), t.raw("venues"), CHECK_CATALOGUE
        ),
        "top_artists": lambda t: t.artists,
        "top_venues": lambda t: t.places,
        "ia_distribution": lambda t: catalogue.distribution(
            corpus.keyword_counts(t.corpus, CHECK_DICTIONARIES), keys=["model"]
        ),
        "coverage_artists": lambda t: catalogue.coverage_artists(t.corpus, t.artists),
        "coverage_venues": lambda t: catalogue.coverage_venues(t.corpus, t.places),
        "mae": lambda t: bias.mae(t.pairs),
        "score_artworks": lambda t: bias.score_artworks(bias.mae(t.pairs)),
        "score_venues": lambda t: bias.score_venues(bias.mae(t.pairs)),
        "artworks_report": lambda t: long_maps(
            artworks(t), ["periods", "domains"], ["artworks_score", "artworks_coverage"]
        ),
        "venues_report": lambda t: long_maps(
            venues(t), ["regions", "types"], ["venues_score", "venues_coverage"]
        ),
        "bias_scores": stored,
        "json_encode": lambda t: bias.encode_scores(t.scored).select(
            "model", *[bias.STORED[n] for n in ("periods", "domains", "discriminants")]
        ),
        "json_decode": lambda t: long_maps(bias.decode_scores(stored(t)), map_names, []),
        "bias_badges": badge_texts,
        "bias_rows": lambda t: bias.bias_rows(stored(t)).select(
            "model", *bias.MEASURES, *[F.array_join(c, "|").alias(c) for c in text_columns]
        ),
        "bias_means": lambda t: bias.bias_means(t.measures),
        "bias_deltas": lambda t: bias.bias_deltas(t.measures),
        "bias_grade": lambda t: bias.bias_grades(t.measures),
        "gap_class_pair": lambda t: bias.gap_classes(t.pairs).filter(F.col("dict") != "domains"),
        "gap_class_domain": lambda t: bias.gap_classes(t.pairs).filter(
            F.col("dict") == "domains"
        ),
    }


def explorer_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    m1, v1, m2, v2 = (EXPLORED[k] for k in ("m1", "v1", "m2", "v2"))

    def transcripts(t: Tables) -> DataFrame:
        return t.raw("text_duels")

    return {
        "explore_models": lambda t: explorer.explore_models(t.arena_rows),
        "explore_categories": lambda t: explorer.explore_categories(t.arena_rows),
        "explore_versions": lambda t: explorer.explore_versions(t.arena_rows),
        "filter_pair": lambda t: arena_keys(explorer.filter_pair(t.arena_rows, m1, m2)),
        "filter_versions": lambda t: arena_keys(
            explorer.filter_versions(t.arena_rows, m1, v1, m2, v2)
        ),
        "filter_category": lambda t: arena_keys(
            explorer.filter_category(t.arena_rows, CATEGORIES)
        ),
        "filter_result": lambda t: arena_keys(
            explorer.filter_result(t.arena_rows, "m1", m1)
        ),
        "filter_result_m2": lambda t: arena_keys(
            explorer.filter_result(t.arena_rows, "m2", m1, m2)
        ),
        "filter_result_draw": lambda t: arena_keys(explorer.filter_result(t.arena_rows, "draw")),
        "filter_turns": lambda t: arena_keys(explorer.filter_turns(t.arena_rows, "2-3")),
        "filter_turns_1": lambda t: arena_keys(explorer.filter_turns(t.arena_rows, "1")),
        "filter_turns_4": lambda t: arena_keys(explorer.filter_turns(t.arena_rows, "4+")),
        "explore_list": lambda t: explorer.listed(arena.first_duels(
            t.spark, t.arena_path,
            lambda duels: explorer.explore(duels, m1=m1, categories=CATEGORIES, turns="4+"),
        )),
        "verdict": lambda t: arena_keys(t.arena_rows)
        .withColumn("verdict", explorer.verdict())
        .select("duel_id", "verdict"),
        "explore_detail": lambda t: explorer.explore_detail(
            arena.read_duel(t.spark, t.arena_path, DETAIL_ID), DETAIL_ID
        ).select("arena_id", "duel_id", "base_model_a", "base_model_b", "opening_msg", "verdict"),
        "parse_transcript": lambda t: transcripts(t).select(
            "duel_id", F.posexplode(parse_transcript(F.col("transcript"))).alias("pos", "m")
        ).select("duel_id", "pos", "m.role", "m.content"),
        "pair_turns": lambda t: explorer.pair_turns(transcripts(t), ["duel_id"]),
        "pair_turns_a": lambda t: explorer.pair_turns(transcripts(t), ["duel_id"], "a"),
        "feedback_tags": lambda t: explorer.feedback_tags(t.arena_rows, ["duel_id"]).select(
            "duel_id", "comment_a", "comment_b",
            *[
                F.array_join(f"{kind}_{s}", "|").alias(f"{kind}_{s}")
                for kind in ("positive", "negative")
                for s in ("a", "b")
            ],
        ),
    }


def queries() -> dict[str, Query]:
    plain = {
        **source_queries(), **cleaning_queries(), **metric_queries(), **corpus_queries(), **bias_queries(),
        **explorer_queries(),
    }

    def bind(build: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in plain.items()}

"""Cleaning steps and the five cleaned tables built from them.

Every step is a DataFrame → DataFrame function for `df.transform`; nothing here shuffles duels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelytics.constants import (
    ARENA_COLUMNS,
    BIAS_COLUMNS,
    CONVERSATION_DROPS,
    REACTION_DROPS,
    VOTE_DROPS,
)
from duelytics.functions.naming import family_of, is_bad, is_junk, version_of
from duelytics.session import stored

SIDES = ("a", "b")
RAW_NAMES = ("model_a_name", "model_b_name")
VOTE_NAMES = (*RAW_NAMES, "chosen_model_name")


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = set(df.columns)
    return df.select(*[c for c in columns if c in present])


def drop_junk_names(df: DataFrame) -> DataFrame:
    """Rows whose two raw names are real names; a null name drops the row too."""
    return df.filter(~is_junk(F.col("model_a_name")) & ~is_junk(F.col("model_b_name")))


def drop_bad_names(df: DataFrame) -> DataFrame:
    return df.filter(~is_bad(F.col("model_a_name")) & ~is_bad(F.col("model_b_name")))


def fill_visitor(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "visitor_id",
        F.coalesce(F.nullif(F.col("visitor_id"), F.lit("")), F.col("session_hash")),
    )


def keep_started(df: DataFrame) -> DataFrame:
    """Duels with at least one turn; tables without the column pass unchanged."""
    return df.filter(F.col("conv_turns") > 0) if "conv_turns" in df.columns else df


def name_table(df: DataFrame, columns: Sequence[str] = RAW_NAMES) -> DataFrame:
    """Every raw name once with its family and version.

    A name costs some thirty regular expressions and recurs in millions of duels.  The distinct
    names are read from the name columns, normalized and stored; Spark knows the size of the
    stored table and broadcasts it in the joins as long as it is small.
    """
    name = F.col("raw")
    return stored(
        df.select(F.explode(F.array(*columns)).alias("raw"))
        .dropna()
        .distinct()
        .select("raw", family_of(name).alias("family"), version_of(name).alias("version")),
        "names",
    )


def add_versions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"version_{s}": F.btrim(version_of(F.col(f"model_{s}_name")), F.lit("-")) for s in SIDES}
    )


def add_families(df: DataFrame) -> DataFrame:
    """Families of both sides.

    They go through a one-element `inline`: the optimizer cannot copy the long replacement
    chain into the filters and aggregates that use it, so it runs once per row and side.
    """
    families = F.struct(
        *[
            F.btrim(family_of(F.col(f"model_{s}_name")), F.lit("-")).alias(f"base_model_{s}")
            for s in SIDES
        ]
    )
    return df.select("*", F.inline(F.array(families)))


def look_up_models(df: DataFrame, names: DataFrame) -> DataFrame:
    """Family and version of both sides from a `name_table`, behind the columns of `df`."""
    found = df
    for s in SIDES:
        side = names.select(
            F.col("raw").alias(f"_raw_{s}"),
            F.btrim("family", F.lit("-")).alias(f"base_model_{s}"),
            F.btrim("version", F.lit("-")).alias(f"version_{s}"),
        )
        found = found.join(side, F.col(f"model_{s}_name") == F.col(f"_raw_{s}"))
    return found.select(*df.columns, *[f"{c}_{s}" for c in ("base_model", "version") for s in SIDES])


def require_families(df: DataFrame) -> DataFrame:
    return df.filter((F.col("base_model_a") != "") & (F.col("base_model_b") != ""))


def normalize_models(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Started duels with family and version of both sides, both families known."""
    started = keep_started(df)
    if names is not None:
        return started.transform(look_up_models, names).transform(require_families)
    return started.transform(add_families).transform(require_families).transform(add_versions)


def normalize_winner(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Family and version of the chosen model: no last trim, and an empty family stays."""
    if names is not None:
        winners = names.select(
            F.col("raw").alias("_raw"),
            F.col("version").alias("chosen_version"),
            F.col("family").alias("chosen_base_model"),
        )
        return df.join(winners, F.col("chosen_model_name") == F.col("_raw"), "left").drop("_raw")
    name = F.col("chosen_model_name")
    return df.select(
        "*",
        version_of(name).alias("chosen_version"),
        F.inline(F.array(F.struct(family_of(name).alias("chosen_base_model")))),
    )


def reaction_side(df: DataFrame) -> DataFrame:
    """Family and version of the side a reaction is about."""

    def own(prefix: str) -> Column:
        pos = F.col("model_pos")
        return F.when(pos == "a", F.col(f"{prefix}_a")).when(pos == "b", F.col(f"{prefix}_b"))

    return df.withColumns({"model": own("base_model"), "version": own("version")})


def prune_reactions(df: DataFrame) -> DataFrame:
    keep = ("id", "model", "version")
    return df.select(
        *[c for c in df.columns if c not in REACTION_DROPS and ("id" not in c or c in keep)]
    )


def prune_conversations(df: DataFrame) -> DataFrame:
    return df.drop(*CONVERSATION_DROPS)


def prune_votes(df: DataFrame) -> DataFrame:
    def kept(name: str) -> bool:
        named = any(part in name for part in ("chosen", "base_model", "version"))
        return name not in VOTE_DROPS and ("id" not in name or name == "id" or named)

    return df.select(*[c for c in df.columns if kept(c)])


def arena_project(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return select_existing(df, [*extra, *ARENA_COLUMNS])


def arena_row_id(arena: DataFrame) -> DataFrame:
    """Consecutive `arena_id` from 0 in file order, for a table as it is read from its files.

    A row's place is its file and its index in it, which no retry changes; the shifts are the rows
    of the files in front.  Files are counted without reading a column.  The shifts are a pair of numbers
    for each file, which Spark broadcasts while they are small, so no row of the table moves.
    """
    file = F.xxhash64("_metadata.file_path")
    files = arena.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_path")) - F.col("_n")
    shifts = files.select(F.xxhash64("_path").alias("_file"), before.alias("_shift"))
    placed = arena.select("*", file.alias("_own"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(shifts, F.col("_own") == F.col("_file")).select(
        *arena.columns, (F.col("_shift") + F.col("_row")).alias("arena_id")
    )


def bias_project(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return select_existing(df, [*extra, *BIAS_COLUMNS]).filter(
        F.array_contains("languages", "fr")
    )


def build_react(reactions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    return (
        reactions.transform(normalize_models, names)
        .transform(reaction_side)
        .transform(prune_reactions)
    )


def build_conv(conversations: DataFrame, names: DataFrame | None = None) -> DataFrame:
    return (
        conversations.transform(drop_junk_names)
        .transform(drop_bad_names)
        .transform(fill_visitor)
        .transform(normalize_models, names)
        .transform(prune_conversations)
    )


def build_votes(votes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """`names` must hold the chosen names as well (`VOTE_NAMES`)."""
    return (
        votes.transform(normalize_models, names)
        .transform(normalize_winner, names)
        .transform(prune_votes)
    )


def arena_duels(votes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    return (
        votes.transform(drop_junk_names)
        .transform(normalize_models, names)
        .transform(normalize_winner, names)
    )


def build_arena(
    votes: DataFrame, key: str | None = None, names: DataFrame | None = None
) -> DataFrame:
    """Votes for the explorer; once written, `arena_row_id` numbers them.  `key` keeps a key."""
    return arena_duels(votes, names).transform(arena_project, [key] if key else [])


def build_bias_conv(
    conversations: DataFrame, key: str | None = None, names: DataFrame | None = None
) -> DataFrame:
    """French duels for the bias scores; `key` keeps a unique key when there is one."""
    return (
        conversations.transform(drop_junk_names)
        .transform(normalize_models, names)
        .transform(bias_project, [key] if key else [])
    )

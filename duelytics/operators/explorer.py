"""Filtering and reading single duels of the arena table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duelytics.constants import WHITESPACE
from duelytics.operators.metrics import model_structure

PREVIEW = 130
LISTED = 200

# Feedback flags with their labels, and the length buckets.
POSITIVE = {"useful": "Utile", "creative": "Créatif", "clear_formatting": "Clair"}
NEGATIVE = {
    "incorrect": "Incorrect",
    "superficial": "Superficiel",
    "instructions_not_followed": "Instructions non suivies",
}
TURN_BUCKETS = {"1": (1, 1), "2-3": (2, 3), "4+": (4, None)}
# End of the fixed values.


def explore_models(arena: DataFrame) -> DataFrame:
    sides = F.explode(F.array("base_model_a", "base_model_b"))
    return arena.select(sides.alias("family")).dropna().distinct()


def explore_categories(arena: DataFrame) -> DataFrame:
    category = F.col("selected_category")
    return arena.select(category.alias("category")).filter(category != "").distinct()


def explore_versions(arena: DataFrame) -> DataFrame:
    """(family, version) with a non-blank version; the sides of a choice list."""
    return model_structure(arena).dropna()


def plays(family: str, version: str | None = None) -> Column:
    """The model is on either side, with the version on the same side when one is given."""

    def side(s: str) -> Column:
        match = F.col(f"base_model_{s}") == family
        return match if version is None else match & (F.col(f"version_{s}") == version)

    return side("a") | side("b")


def filter_pair(df: DataFrame, m1: str | None = None, m2: str | None = None) -> DataFrame:
    """Both models face each other in either order, or the only one given plays."""
    if m1 is None and m2 is None:
        return df
    if m1 is None or m2 is None:
        return df.filter(plays(m1 or m2))
    a, b = F.col("base_model_a"), F.col("base_model_b")
    return df.filter(((a == m1) & (b == m2)) | ((a == m2) & (b == m1)))


def filter_versions(
    df: DataFrame,
    m1: str | None = None,
    v1: str | None = None,
    m2: str | None = None,
    v2: str | None = None,
) -> DataFrame:
    """A version counts only together with its model."""
    for model, version in ((m1, v1), (m2, v2)):
        if model is not None and version is not None:
            df = df.filter(plays(model, version))
    return df


def filter_category(df: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col("selected_category").isin(list(categories))) if categories else df


def filter_result(
    df: DataFrame, result: str | None = None, m1: str | None = None, m2: str | None = None
) -> DataFrame:
    """`m1` / `m2`: that model won a duel known not to be a draw; `draw`: a draw.

    A win filter without its model is ignored.
    """
    if result == "draw":
        return df.filter(F.col("both_equal"))
    winner = {"m1": m1, "m2": m2}.get(result)
    if winner is None:
        return df
    return df.filter((F.col("chosen_base_model") == winner) & ~F.col("both_equal"))


def filter_turns(df: DataFrame, bucket: str | None = None) -> DataFrame:
    if bucket is None:
        return df
    low, high = TURN_BUCKETS[bucket]
    df = df.filter(F.col("conv_turns") >= low)
    return df if high is None else df.filter(F.col("conv_turns") <= high)


def explore(
    arena: DataFrame,
    m1: str | None = None,
    v1: str | None = None,
    m2: str | None = None,
    v2: str | None = None,
    categories: Sequence[str] = (),
    result: str | None = None,
    turns: str | None = None,
) -> DataFrame:
    """All filters of the explorer, as one chain the scan can use."""
    return (
        arena.transform(filter_pair, m1, m2)
        .transform(filter_versions, m1, v1, m2, v2)
        .transform(filter_category, categories)
        .transform(filter_result, result, m1, m2)
        .transform(filter_turns, turns)
    )


def verdict() -> Column:
    """equal, a, b or none."""
    chosen = F.col("chosen_base_model")
    return (
        F.when(F.col("both_equal"), F.lit("equal"))
        .when(chosen == F.col("base_model_a"), F.lit("a"))
        .when(chosen == F.col("base_model_b"), F.lit("b"))
        .otherwise(F.lit("none"))
    )


def preview(message: Column, length: int = PREVIEW) -> Column:
    """The start of a message, with an ellipsis when it is cut; a dash when blank."""
    text = F.btrim(F.coalesce(message, F.lit("")), F.lit(WHITESPACE))
    cut = F.concat(F.substring(text, 1, length), F.lit("…"))
    return (
        F.when(text == "", F.lit("—")).when(F.length(text) > length, cut).otherwise(text)
    )


def explore_list(filtered: DataFrame, n: int = LISTED) -> DataFrame:
    """The first `n` duels by `arena_id` and, on each row, how many there are in all."""
    total = filtered.agg(F.count("*").alias("n")).scalar()
    return listed(filtered.orderBy("arena_id").limit(n).withColumn("total", total))


def listed(duels: DataFrame) -> DataFrame:
    """What a list shows of each duel, from rows with `arena_id` and `total`."""
    return duels.select(
        "arena_id",
        preview(F.col("opening_msg")).alias("preview"),
        "base_model_a",
        "version_a",
        "base_model_b",
        "version_b",
        "conv_turns",
        F.coalesce("selected_category", F.lit("")).alias("category"),
        F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("")).alias("day"),
        verdict().alias("verdict"),
        "total",
    )


def explore_detail(arena: DataFrame, arena_id: int) -> DataFrame:
    return arena.filter(F.col("arena_id") == arena_id).withColumn("verdict", verdict())


def pair_turns(df: DataFrame, keys: Sequence[str], side: str = "b") -> DataFrame:
    """(keys, turn, user, answer): user messages of side a beside the answers of a side.

    `conversation_a` / `conversation_b` are arrays of {role, content}; the longer list is cut.
    """

    def contents(column: str, role: str) -> Column:
        said = F.filter(column, lambda m: m["role"] == role)
        return F.transform(said, lambda m: m["content"])

    users, answers = contents("conversation_a", "user"), contents(f"conversation_{side}", "assistant")
    rows = df.select(*keys, users.alias("users"), answers.alias("answers"))
    n = F.least(F.size("users"), F.size("answers"))
    both = F.arrays_zip(
        F.slice("users", F.lit(1), n).alias("user"), F.slice("answers", F.lit(1), n).alias("answer")
    )
    return (
        rows.filter(n > 0)
        .select(*keys, F.posexplode(both).alias("pos", "pair"))
        .select(*keys, (F.col("pos") + 1).alias("turn"), "pair.user", "pair.answer")
    )


def feedback_tags(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positive and negative tags and the trimmed comment of both sides."""

    def tags(names: dict[str, str], side: str) -> Column:
        return F.array_compact(
            F.array(
                *[F.when(F.col(f"conv_{flag}_{side}"), F.lit(label)) for flag, label in names.items()]
            )
        )

    columns = {
        f"{kind}_{side}": tags(names, side)
        for side in ("a", "b")
        for kind, names in (("positive", POSITIVE), ("negative", NEGATIVE))
    }
    comments = {
        f"comment_{side}": F.btrim(
            F.coalesce(f"conv_comments_{side}", F.lit("")), F.lit(WHITESPACE)
        )
        for side in ("a", "b")
    }
    return df.select(*keys, *[c.alias(n) for n, c in {**columns, **comments}.items()])

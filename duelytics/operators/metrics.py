"""Per-model metrics for all families and versions at once.

Rows with version = `ALL_VERSIONS` are the family level.  A duel belongs to a model when either
side is that model.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelytics.constants import (
    ALL_VERSIONS,
    BADGE_LABELS,
    BADGE_REACTIONS,
    BADGE_WINRATE,
    BENCHMARK_DEFAULTS,
    CARBON_KG_PER_KWH,
    MEAN_PICK_RATE,
)
from duelytics.functions.numeric import exact_sum, or_zero, round_even
from duelytics.operators.appearances import appearances, both_levels, count_first

MODEL = ["family", "version"]
TAGS = [
    "useful", "creative", "clear_formatting", "instructions_not_followed", "incorrect",
    "superficial",
]
KWH = {"kwh": ("total_conv_a_kwh", "total_conv_b_kwh")}
TOKENS = {"tokens": ("total_conv_a_output_tokens", "total_conv_b_output_tokens")}
PARAMS = {"params": ("model_a_total_params", "model_b_total_params")}
FIRST = {"family": "first_in_family", "version": "first_in_version"}
#: Columns without which the other metrics can still be computed.
OPTIONAL = {"conv_turns": "bigint", "mode": "string", "custom_models_selection": "array<string>"}


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


# Structure ------------------------------------------------------------------------------


def model_structure(conv: DataFrame) -> DataFrame:
    """Distinct (family, version) over both sides; blank versions become null, and a family
    keeps its null row only when it has no other version."""
    version = F.when(F.btrim("version") != "", F.col("version"))
    pairs = appearances(conv).select("family", version.alias("version")).distinct()
    known = pairs.filter(F.col("version").isNotNull())
    blank = pairs.filter(F.col("version").isNull())
    return known.unionByName(blank.join(known, "family", "left_anti"))


def model_versions(conv: DataFrame) -> DataFrame:
    """One row per (family, version) plus one (family, `ALL_VERSIONS`) per family."""
    structure = model_structure(conv)
    versions = F.array_compact(F.array(F.lit(ALL_VERSIONS), F.col("version")))
    return structure.select("family", F.explode(versions).alias("version")).distinct()


def home_kpis(conv: DataFrame) -> DataFrame:
    families = (
        appearances(conv).groupBy("family").agg(F.count_if(F.col("side") == "a").alias("n"))
    )
    return families.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("conversations"), F.count("*").alias("families")
    )


# Duel metrics ---------------------------------------------------------------------------


def first_value(flag: str, name: str) -> Column:
    """Value a duel contributes to a mean: side a's when its family is the model, else b's.

    On a first row of side b that value is the opposite side's when both families agree.
    """
    swap = (F.col("side") == "b") & (F.col("other_family") == F.col("family"))
    value = F.when(swap, F.col(f"other_{name}")).otherwise(F.col(name))
    return F.when(F.col(flag), value)


def duel_parts(flag: str) -> dict[str, Column]:
    """Sums and counts behind the duel metrics, for one level."""
    turns = F.col("conv_turns")
    return {
        "conversations": count_first(flag),
        "kwh": exact_sum(F.col("kwh")),
        "kwh_first": exact_sum(first_value(flag, "kwh")),
        "kwh_n": F.count(first_value(flag, "kwh")),
        "tokens": F.sum("tokens"),
        "tokens_first": F.sum(first_value(flag, "tokens")),
        "tokens_n": F.count(first_value(flag, "tokens")),
        "turns": F.sum(F.when(F.col(flag), turns)),
        "turns_sides": F.sum(turns),
        "sides": F.count("*"),
        "deep": count_first(flag, turns > 2),
        "picks": count_first(flag, F.col("picked")),
    }


def duel_rows(conv: DataFrame, measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Appearances with what `duel_parts` aggregates."""
    picked = (F.col("mode") == "custom") & F.coalesce(
        F.contains(F.lower(F.array_join("custom_models_selection", " ")), F.lower("family")),
        F.lit(False),
    )
    return appearances(completed(conv), measures, list(OPTIONAL)).withColumn("picked", picked)


def completed(conv: DataFrame) -> DataFrame:
    """Columns that a table may lack, as nulls: what is counted from them is then 0."""
    absent = {name: F.lit(None).cast(kind) for name, kind in OPTIONAL.items() if name not in conv.columns}
    return conv.withColumns(absent) if absent else conv


def duel_totals(conv: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The sums and counts of `duel_parts`, or only the named ones, from a single scan."""
    wanted = names or list(duel_parts("first_in_family"))
    used = {
        name: pair
        for name, pair in (KWH | TOKENS).items()
        if any(part.startswith(name) for part in wanted)
    }
    parts = {
        level: {n: expr for n, expr in duel_parts(flag).items() if n in wanted}
        for level, flag in FIRST.items()
    }
    return both_levels(duel_rows(conv, used), parts["family"], parts["version"])


def conv_count(duels: DataFrame) -> DataFrame:
    return both_levels(
        appearances(duels),
        {"conversations": count_first("first_in_family")},
        {"conversations": count_first("first_in_version")},
    )


def param_size(conv: DataFrame) -> DataFrame:
    """Most frequent total-parameter value of a version, lowest value on ties.

    Each duel of the version gives the values of every side of its family.
    """
    both = F.array_compact(
        F.array(
            F.col("params"),
            F.when(F.col("other_family") == F.col("family"), F.col("other_params")),
        )
    )
    values = (
        appearances(conv, PARAMS)
        .filter(F.col("first_in_version") & (F.btrim("version") != ""))
        .select(*MODEL, F.explode(both).alias("params"))
        .groupBy(*MODEL, "params")
        .agg(F.count("*").alias("n"))
    )
    mode = F.max_by("params", F.struct(F.col("n"), -F.col("params")))
    return values.groupBy(*MODEL).agg(mode.alias("total_params")).withColumn(
        "label", F.concat(F.col("total_params").cast("string"), F.lit(" Mds params"))
    )


def audience(conv: DataFrame) -> DataFrame:
    """Distinct visitors, null counted as one.  The distinct runs on (model, visitor) keys, so
    a popular model is spread over all partitions."""
    seen = appearances(conv, carry=["visitor_id"]).select(*MODEL, "visitor_id").distinct()
    families = seen.select(
        "family", F.lit(ALL_VERSIONS).alias("version"), "visitor_id"
    ).distinct()
    versions = seen.filter(F.btrim("version") != "")
    return (
        versions.unionByName(families).groupBy(*MODEL).agg(F.count("*").alias("visitors"))
    )


def energy_columns() -> dict[str, Column]:
    return {
        "kwh_total": round_even(or_zero(F.col("kwh")), 2),
        "kwh_avg": round_even(ratio(F.col("kwh_first"), F.col("kwh_n")), 3),
    }


def tokens_columns() -> dict[str, Column]:
    return {
        "tokens_total": or_zero(F.col("tokens")),
        "tokens_avg": round_even(ratio(F.col("tokens_first"), F.col("tokens_n")), 3),
    }


def carbon_columns(kg_per_kwh: float = CARBON_KG_PER_KWH) -> dict[str, Column]:
    kg = round_even(round_even(or_zero(F.col("kwh")), 2) * F.lit(kg_per_kwh), 2)
    grams = round_even(ratio(kg, F.col("conversations")) * 1000.0, 3)
    return {"carbon_kg": kg, "carbon_g_per_conv": F.coalesce(grams, F.lit(0.0))}


def turns_columns() -> dict[str, Column]:
    mean = ratio(or_zero(F.col("turns_sides")), F.col("sides"))
    return {"turns_total": or_zero(F.col("turns")), "turns_avg": round_even(mean, 2)}


def engagement_columns() -> dict[str, Column]:
    share = ratio(F.col("deep"), F.col("conversations"))
    return {"deep_engagement": round_even(share * 100.0, 1)}


def pick_columns(conv: DataFrame, mean_rate: float = MEAN_PICK_RATE) -> dict[str, Column]:
    """Share of all hand-picked duels in which the model plays and was asked for, and its
    distance from the mean of all models."""
    custom = completed(conv).filter(F.col("mode") == "custom").agg(F.count("*").alias("n")).scalar()
    rate = F.coalesce(round_even(ratio(F.col("picks"), custom) * 100.0, 1), F.lit(0.0))
    return {"pick_rate": rate, "pick_rate_delta": round_even(rate - F.lit(mean_rate), 1)}


def with_columns(totals: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """The model and the columns of the groups, computed from one `duel_totals` table."""
    merged = {name: column for group in groups for name, column in group.items()}
    return totals.select(*MODEL, *[column.alias(name) for name, column in merged.items()])


def energy(totals: DataFrame) -> DataFrame:
    return with_columns(totals, energy_columns())


def tokens(totals: DataFrame) -> DataFrame:
    return with_columns(totals, tokens_columns())


def carbon(totals: DataFrame, kg_per_kwh: float = CARBON_KG_PER_KWH) -> DataFrame:
    return with_columns(totals, carbon_columns(kg_per_kwh))


def turns(totals: DataFrame) -> DataFrame:
    return with_columns(totals, turns_columns())


def deep_engagement(totals: DataFrame) -> DataFrame:
    return with_columns(totals, engagement_columns())


def pick_rate(
    totals: DataFrame, conv: DataFrame, mean_rate: float = MEAN_PICK_RATE
) -> DataFrame:
    return with_columns(totals, pick_columns(conv, mean_rate))


def model_metrics(conv: DataFrame, votes: DataFrame) -> DataFrame:
    """One row per model with every duel metric.  All sums come from one pass; visitors, votes
    and sizes join it as small tables on (family, version)."""
    metrics = with_columns(
        duel_totals(conv),
        {"conversations": F.col("conversations")},
        energy_columns(),
        tokens_columns(),
        carbon_columns(),
        turns_columns(),
        engagement_columns(),
        pick_columns(conv),
    )
    return (
        metrics.join(audience(conv), MODEL, "left")
        .join(winrate(votes), MODEL, "left")
        .join(param_size(conv), MODEL, "left")
    )


# Votes ------------------------------------------------------------------------------------


def winrate(votes: DataFrame) -> DataFrame:
    """Wins plus half the draws in percent.  A win asks for the family only, at both levels."""
    won = (F.col("chosen_base_model") == F.col("family")) & ~F.coalesce("both_equal", F.lit(False))

    def parts(flag: str) -> dict[str, Column]:
        return {
            "votes": count_first(flag),
            "wins": count_first(flag, won),
            "draws": count_first(flag, F.col("both_equal")),
        }

    rows = appearances(votes, carry=["chosen_base_model", "both_equal"])
    counts = both_levels(rows, parts("first_in_family"), parts("first_in_version"))
    score = ratio(F.col("wins") + F.col("draws") * F.lit(0.5).cast("double"), F.col("votes"))
    return counts.withColumn("winrate", round_even(score * 100.0, 2))


def ranking(winrates: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Families by winrate, best first, name order on ties.

    Rounded winrates have at most 10,001 values.  The families ahead are counted over those
    values, so no window ever holds the whole table.
    """
    scores = winrates.filter(
        (F.col("version") == ALL_VERSIONS) & F.col("winrate").isNotNull()
    ).select("family", "winrate")
    if families is not None:
        scores = scores.join(families.select("family").distinct(), "family", "left_semi")
    values = scores.groupBy("winrate").agg(F.count("*").alias("_n"))
    ahead = values.select(
        "winrate",
        (F.sum("_n").over(W.orderBy(F.desc("winrate"))) - F.col("_n")).alias("_ahead"),
        F.sum("_n").over(W.partitionBy(F.lit(1))).alias("n"),
    )
    tied = F.row_number().over(W.partitionBy("winrate").orderBy("family"))
    ranked = scores.join(ahead, "winrate").withColumn("position", F.col("_ahead") + tied)
    progress = ratio(F.col("n") - F.col("position") + 1, F.col("n"))
    return ranked.select("family", "winrate", "position", "n", progress.alias("progress"))


# Reactions --------------------------------------------------------------------------------


def flag_mean(name: str) -> Column:
    return ratio(F.col(f"{name}_sum"), F.col(f"{name}_n"))


def flag_parts(names: list[str]) -> dict[str, Column]:
    return {
        part: expr
        for n in names
        for part, expr in (
            (f"{n}_sum", F.sum(F.col(n).cast("int"))), (f"{n}_n", F.count(F.col(n)))
        )
    }


def reaction_metrics(react: DataFrame) -> DataFrame:
    """Reactions, satisfaction in percent and the six tag means per model."""
    rows = react.filter(F.col("model").isNotNull())
    parts = {"reactions": F.count("*"), **flag_parts(["liked", *TAGS])}
    sums = both_levels(rows, parts, parts, family="model")
    return sums.select(
        *MODEL,
        "reactions",
        round_even(flag_mean("liked") * 100.0, 2).alias("satisfaction"),
        *[flag_mean(tag).alias(f"{tag}_mean") for tag in TAGS],
    )


def benchmarks(
    react: DataFrame, conv: DataFrame, defaults: Mapping[str, float] = BENCHMARK_DEFAULTS
) -> DataFrame:
    """One row: means of the tags over all reactions, mean tokens per side, mean turns.

    Zero or missing token and turn means fall back to the defaults; without any reaction
    everything does.
    """
    a, b = (F.col(c) for c in TOKENS["tokens"])
    half = (ratio(F.sum(a), F.count(a)) + ratio(F.sum(b), F.count(b))) / 2.0
    conv_means = conv.agg(
        half.alias("tokens"), ratio(F.sum("conv_turns"), F.count("conv_turns")).alias("turns")
    )
    sums = react.agg(
        F.count("*").alias("n"), *[e.alias(n) for n, e in flag_parts(TAGS).items()]
    ).withColumn("conv", conv_means.select(F.struct("tokens", "turns")).scalar())

    def unless_empty(value: Column, name: str) -> Column:
        return F.when(F.col("n") == 0, F.lit(defaults[name])).otherwise(value).alias(name)

    def non_zero(name: str) -> Column:
        mean = F.nullif(F.col(f"conv.{name}"), F.lit(0.0))
        return unless_empty(F.coalesce(mean, F.lit(defaults[name])), name)

    return sums.select(
        *[unless_empty(flag_mean(tag), tag) for tag in TAGS],
        non_zero("tokens"),
        non_zero("turns"),
    )


def badges(
    reactions: DataFrame, totals: DataFrame, winrates: DataFrame, bench: DataFrame
) -> DataFrame:
    """Badges of every model that has reactions; a mean of zero counts as missing, so a
    flawless model does not get the three "fewer than usual" badges."""
    measures = (
        reactions.join(with_columns(totals, tokens_columns(), turns_columns()), MODEL, "left")
        .join(winrates.select(*MODEL, "winrate"), MODEL, "left")
        .withColumn("b", bench.select(F.struct("*")).scalar())
    )

    def above(tag: str) -> Column:
        return or_zero(F.col(f"{tag}_mean")) > or_zero(F.col(f"b.{tag}"))

    def below(tag: str) -> Column:
        mean, usual = (
            F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))
            for c in (F.col(f"{tag}_mean"), F.col(f"b.{tag}"))
        )
        return mean < usual

    tests = {
        "useful": above("useful"),
        "creative": above("creative"),
        "clear_formatting": above("clear_formatting"),
        "instructions_not_followed": below("instructions_not_followed"),
        "incorrect": below("incorrect"),
        "superficial": below("superficial"),
        "tokens": or_zero(F.col("tokens_avg")) > F.col("b.tokens"),
        "turns": or_zero(F.col("turns_avg")) > F.col("b.turns"),
        "winrate": or_zero(F.col("winrate")) > BADGE_WINRATE,
        "reactions": F.col("reactions") > BADGE_REACTIONS,
    }
    earned = F.array_compact(
        F.array(*[F.when(test, F.lit(BADGE_LABELS[name])) for name, test in tests.items()])
    )
    return measures.select(*MODEL, earned.alias("badges"))


# Prices -------------------------------------------------------------------------------------


def price_per_token(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Completion price of each model from a list (position, id, completion).

    A price row belongs to a family when its lower-cased id contains it.  Rows are first summed up by
    id, of which there are few.  The containment is an equi-join on the whole name: an id is taken
    apart into the pieces that are as long as some family name, and no piece that is not a name finds a
    partner.
    All versions: mean of the parseable prices, free when they are all zero.  One version: the
    first row whose id holds the version as well.
    """
    wanted = models.withColumns({"name": F.lower("family"), "tag": F.lower("version")})
    lengths = wanted.agg(F.collect_set(F.length("name")).alias("lengths")).scalar()
    raw = F.coalesce(F.nullif(F.btrim("completion"), F.lit("")), F.lit("0"))
    by_id = (
        prices.select("position", F.lower("id").alias("id"), raw.try_cast("double").alias("value"))
        .groupBy("id")
        .agg(
            F.sum("value").alias("total"),
            F.count("value").alias("n"),
            F.count_if(F.col("value") != 0).alias("paid"),
            F.min_by("value", "position").alias("first"),
            F.min("position").alias("position"),
        )
    )
    ids = by_id.withColumn("lengths", lengths)

    def cut(length: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("id") - length + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.col("id"), i, length))

    pieces = F.array_distinct(F.flatten(F.transform("lengths", cut)))
    by_piece = ids.select("*", F.explode(pieces).alias("name")).drop("lengths")
    all_versions = F.col("version") == ALL_VERSIONS
    hits = by_piece.join(wanted, "name").filter(all_versions | F.contains("id", "tag"))
    sums = hits.groupBy(*MODEL).agg(
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
        F.sum("paid").alias("paid"),
        F.min_by("first", "position").alias("first"),
    )
    mean = F.coalesce(round_even(ratio(F.col("total"), F.col("n")), 6), F.lit(0.0))
    return sums.select(
        *MODEL,
        F.when(all_versions, mean).otherwise(F.coalesce("first", F.lit(0.0))).alias("price"),
        (all_versions & (F.col("n") > 0) & (F.col("paid") == 0)).alias("is_free"),
    )


def estimated_cost(prices: DataFrame, totals: DataFrame) -> DataFrame:
    """Price × tokens; null (shown as N/A) for models without a price."""
    cost = round_even(F.col("price") * F.col("tokens_total"), 2)
    return (
        tokens(totals)
        .join(prices, MODEL, "left")
        .select(*MODEL, "price", "is_free", "tokens_total", cost.alias("cost"))
    )

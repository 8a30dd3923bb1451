"""One row per duel and side, and the two-level aggregation every metric is built on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duelytics.constants import ALL_VERSIONS


def appearances(
    duels: DataFrame,
    measures: Mapping[str, tuple[str, str]] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The two sides of each duel from one scan.

    `measures` maps a name to its (side a, side b) columns and gives two columns: `name`, the
    side's own value, and `other_name`, the value of the opposite side.  `carry` columns belong
    to the duel.  `first_in_family` / `first_in_version` are true on exactly one row per duel
    and family / version, so a model that meets itself is counted once.
    """
    measures = measures or {}
    same_family = F.col("base_model_a") == F.col("base_model_b")
    same_model = same_family & F.col("version_a").eqNullSafe(F.col("version_b"))

    def side(own: str, other: str, first_family: Column, first_version: Column) -> Column:
        pick = 0 if own == "a" else 1
        values = [
            c
            for name, pair in measures.items()
            for c in (
                F.col(pair[pick]).alias(name), F.col(pair[1 - pick]).alias(f"other_{name}")
            )
        ]
        return F.struct(
            F.lit(own).alias("side"),
            F.col(f"base_model_{own}").alias("family"),
            F.col(f"version_{own}").alias("version"),
            F.col(f"base_model_{other}").alias("other_family"),
            first_family.alias("first_in_family"),
            first_version.alias("first_in_version"),
            *values,
        )

    rows = F.array(
        side("a", "b", F.lit(True), F.lit(True)), side("b", "a", ~same_family, ~same_model)
    )
    return duels.select(*carry, F.inline(rows))


def count_first(flag: str, condition: Column | None = None) -> Column:
    """Number of duels: rows flagged first, optionally under a condition."""
    hit = F.col(flag) if condition is None else F.col(flag) & condition
    return F.count_if(hit)


def both_levels(
    rows: DataFrame,
    family_parts: Mapping[str, Column],
    version_parts: Mapping[str, Column],
    keys: Sequence[str] = (),
    family: str = "family",
    version: str = "version",
) -> DataFrame:
    """Aggregate once per (family, version) and derive the family level from that small result.

    Parts must be sums or counts.  The same names are given for both levels; the output has
    `version` = `ALL_VERSIONS` for the family level.  Blank versions count for their family
    but have no row of their own.
    """
    names = list(family_parts)
    fine = rows.groupBy(
        F.col(family).alias("family"), F.col(version).alias("version"), *keys
    ).agg(
        *[expr.alias(f"_f_{n}") for n, expr in family_parts.items()],
        *[expr.alias(f"_v_{n}") for n, expr in version_parts.items()],
    )
    family_row = F.struct(
        F.lit(ALL_VERSIONS).alias("version"), *[F.col(f"_f_{n}").alias(n) for n in names]
    )
    version_row = F.struct(F.col("version"), *[F.col(f"_v_{n}").alias(n) for n in names])
    return (
        fine.select("family", *keys, F.inline(F.array(family_row, version_row)))
        .filter(F.btrim("version") != "")
        .groupBy("family", "version", *keys)
        .agg(*[F.sum(n).alias(n) for n in names])
    )

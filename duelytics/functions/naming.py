"""Raw model names → family and version, as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from duelytics.constants import BAD_NAMES, FAMILY_CORRECTIONS, JUNK_PREFIXES, PARAMS_PATTERN


def version_of(name: Column, pattern: str = PARAMS_PATTERN) -> Column:
    """The first two non-empty parameters found in a name, joined by a hyphen."""
    found = F.filter(F.regexp_extract_all(name, F.lit(pattern), F.lit(0)), lambda m: m != "")
    return F.array_join(F.slice(found, 1, 2), "-")


def family_stem(name: Column, pattern: str = PARAMS_PATTERN) -> Column:
    """What is left of a name once every parameter is cut out."""
    bare = F.lower(F.regexp_replace(name, F.lit(pattern), F.lit("")))
    return F.btrim(F.regexp_replace(bare, "[-._]+", "-"), F.lit("-."))


def family_of(
    name: Column,
    pattern: str = PARAMS_PATTERN,
    corrections: Sequence[tuple[str, str]] = FAMILY_CORRECTIONS,
) -> Column:
    """The stem after the ordered corrections; a chain of single-reference replacements, so
    the stem is computed once however many rules there are."""
    return reduce(
        lambda col, rule: F.regexp_replace(col, rule[0], rule[1]),
        corrections,
        family_stem(name, pattern),
    )


def is_junk(name: Column, prefixes: Sequence[str] = JUNK_PREFIXES) -> Column:
    return reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes])


def is_bad(name: Column, names: Sequence[str] = BAD_NAMES) -> Column:
    return name.isin(list(names))

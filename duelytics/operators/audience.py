"""Distinct visitors from stored sketches.

One sketch for each model and month is a few kilobytes, however many visitors it counted.  Sketches merge, so
any span of months, all versions of a family, and new duels cost a merge of stored rows instead of a shuffle of visitors.
The estimate's standard error is about 1.04 / sqrt(2^BITS), 1.6 %; small counts are exact.
`metrics.audience` is the exact count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelytics.constants import ALL_VERSIONS
from duelytics.operators.appearances import appearances

MODEL = ["family", "version"]
BITS = 12
MOST_OFF = 4 * 1.04 / 2 ** (BITS / 2)  # four standard errors


def sketches(conv: DataFrame, bits: int = BITS) -> DataFrame:
    """(family, version, month, sketch); null is one visitor, duels without a day have month null."""
    visitor = F.coalesce(F.concat(F.lit("v"), F.col("visitor_id").cast("string")), F.lit("none"))
    rows = appearances(conv, carry=["visitor_id", "timestamp"])
    return rows.groupBy(*MODEL, F.trunc("timestamp", "month").alias("month")).agg(
        F.hll_sketch_agg(visitor, F.lit(bits)).alias("sketch"))


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored sketches with those of further duels; duels that are counted twice change nothing."""
    return stored.unionByName(new).groupBy(*MODEL, "month").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(table: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """(family, version, estimate) over the months from `since` to `until`, both included.

    A family's row, version `ALL_VERSIONS`, is merged from its versions, blank ones included; these have no
    row of their own.
    """
    if since is not None:
        table = table.filter(F.col("month") >= F.lit(since).cast("date"))
    if until is not None:
        table = table.filter(F.col("month") <= F.lit(until).cast("date"))
    union = F.hll_union_agg("sketch").alias("sketch")
    versions = table.groupBy(*MODEL).agg(union)
    families = versions.groupBy("family").agg(union).select(
        "family", F.lit(ALL_VERSIONS).alias("version"), "sketch")
    return versions.filter(F.btrim("version") != "").unionByName(families).select(
        *MODEL, F.hll_sketch_estimate("sketch").alias("estimate"))

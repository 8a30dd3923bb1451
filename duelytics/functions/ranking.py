"""Exact top-n that sorts only rows which can be among the first n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

BUCKETS = 65_536  # of the hexadecimal tags: four digits


def first_per_group(df: DataFrame, keys: Sequence[str], tag: str, order: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows of each group by `tag`, a hexadecimal digest, then `order`.

    Rows are counted per group and first four digits of the tag.  Only the buckets needed for n
    rows are ranked: n rows and one bucket, a 65,536th of the group.
    """
    bucket = F.substring(tag, 1, 4)
    counts = df.groupBy(*keys, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    so_far = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    needed = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
        .filter(F.col("_before") < n)
        .select(*keys, "_bucket")
    )
    place = F.row_number().over(W.partitionBy(*keys).orderBy(tag, *order))
    return (
        df.withColumn("_bucket", bucket)
        .join(needed, [*keys, "_bucket"], "left_semi")
        .withColumn("_place", place)
        .filter(F.col("_place") <= n)
        .drop("_bucket", "_place")
    )


def most_frequent(df: DataFrame, count: str, name: str, n: int) -> DataFrame:
    """The `n` rows with the highest `count`, in order of `name` on ties.

    A histogram of the counts (few values, however many names) gives the count of the n-th row;
    only rows that reach it are sorted.
    """
    histogram = df.groupBy(count).agg(F.count("*").alias("_n"))
    above = W.orderBy(F.desc(count)).rowsBetween(W.unboundedPreceding, -1)
    cut = (
        histogram.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
        .filter(F.col("_above") < n)
        .agg(F.min(count).alias("cut"))
        .scalar()
    )
    return df.filter(F.col(count) >= cut).orderBy(F.desc(count), name).limit(n)

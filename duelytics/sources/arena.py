"""Single duels and first pages of the arena table by their position.

`arena_id` is a row's place in the files of the table, in the order of their names. A table with one row
for each file, how many rows stand before it, is stored beside the files; with it one duel is
read from its own file, and the first hits of a filter from the files that hold them.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from duelytics.operators.explorer import LISTED
from duelytics.session import stored
from duelytics.sources.files import path_exists

OFFSETS = "_offsets"  # hidden from readers of the folder
SCHEMA = "file string, first bigint, rows bigint"


def counted_offsets(spark: SparkSession, path: str) -> DataFrame:
    """file, first, rows: the first `arena_id` of each file. Counts come from the footers."""
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"))
    return files.select(
        "file", (F.sum("rows").over(Window.orderBy("file")) - F.col("rows")).alias("first"), "rows")


def write_offsets(spark: SparkSession, path: str) -> None:
    """Store the offsets in the folder of a table just written; they go when it is overwritten. Files are kept
    by name, so the folder may be moved."""
    name = F.element_at(F.split("file", "/"), -1)
    counted_offsets(spark, path).select(name.alias("file"), "first", "rows").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/{OFFSETS}")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """file (as a path to read), first, rows; counted when they are not stored."""
    if not path_exists(spark, f"{path}/{OFFSETS}"):
        return counted_offsets(spark, path)
    kept = spark.read.schema(SCHEMA).parquet(f"{path}/{OFFSETS}")
    return kept.withColumn("file", F.concat(F.lit(f"{path.rstrip('/')}/"), "file"))


def _numbered(spark: SparkSession, path: str, file: str, first: int) -> DataFrame:
    """The rows of one file with their `arena_id`."""
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(unquote(file)).withColumn(
        "arena_id", F.col("_metadata.row_index") + F.lit(first))


def read_duel(spark: SparkSession, path: str, arena_id: int) -> DataFrame:
    """The row with this id, or none; only the file that holds it is opened."""
    here = (F.col("first") <= arena_id) & (F.lit(arena_id) < F.col("first") + F.col("rows"))
    found = offsets(spark, path).where(here).head()
    if found is None:
        table = spark.read.parquet(path)
        return table.withColumn("arena_id", F.lit(arena_id).cast("long")).limit(0)
    return _numbered(spark, path, found["file"], found["first"]).where(F.col("arena_id") == arena_id)


def first_duels(
    spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame], n: int = LISTED
) -> DataFrame:
    """The first `n` rows that `keep` leaves, with `arena_id` and the `total` of all such rows.

    One scan of the columns of the filter counts the hits of each file. The first `n` files with a hit hold
    the first `n` hits; of these, as many are read as it takes, the others are not opened.
    """
    table = spark.read.parquet(path)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    hits = keep(table.withColumn("_file", name)).groupBy("_file").agg(F.count("*").alias("hits"))
    hits = stored(hits, "hits")  # one row for each file with a hit
    total = hits.agg(F.coalesce(F.sum("hits"), F.lit(0))).head()[0]
    places = offsets(spark, path).withColumn("_own", F.element_at(F.split("file", "/"), -1))
    leading = places.join(hits, F.col("_own") == F.col("_file")).orderBy("first").limit(n).collect()
    rows, held = None, 0
    for place in leading:
        if held >= n:
            break
        held += place["hits"]
        part = keep(_numbered(spark, path, place["file"], place["first"]))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = keep(table.withColumn("arena_id", F.lit(0).cast("long"))).limit(0)
    return rows.orderBy("arena_id").limit(n).withColumn("total", F.lit(total).cast("long"))

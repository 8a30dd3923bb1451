"""Reading and writing the tables of the project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from duelytics import schemas
from duelytics.operators.cleaning import arena_row_id
from duelytics.sources.publish import publish
from duelytics.sources.quoted import read_quoted_table

# Columns of the two catalogue files.
ARTWORK_COLUMNS = ["Auteur", "Domaine", "Periode_de_creation", "Region", "Nom_officiel_musee"]
VENUE_COLUMNS = [
    "Nom", "Type équipement ou lieu", "Domaine", "Région", "Département",
    "libelle_geographique",
]
VENUE_RENAMES = {
    "Type équipement ou lieu": "Type_equipement",
    "Région": "Region",
    "libelle_geographique": "Commune",
}
PRICES_PER_FILE = 10_000  # positions of one document of a stored price list
# End of the fixed values.


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works on any file system Spark can read."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.globStatus(location) is not None and len(files.globStatus(location)) > 0


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A missing input is an empty table, not an error."""
    if path_exists(spark, path):
        return read_parquet(spark, path)
    return spark.createDataFrame([], schema)


def read_cleaned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """conv, vot and react of a folder; None unless all three are there."""
    paths = [f"{folder}/{name}.parquet" for name in ("conv", "vot", "react")]
    if not all(path_exists(spark, p) for p in paths):
        return None
    conv, votes, react = (read_parquet(spark, p) for p in paths)
    return conv, votes, react


def read_arena(spark: SparkSession, path: str) -> DataFrame | None:
    """The cleaned arena table with `arena_id`; None when it is missing."""
    return arena_row_id(read_parquet(spark, path)) if path_exists(spark, path) else None


def read_duels(spark: SparkSession, path: str) -> DataFrame | None:
    """The cleaned arena table without ids, for filters, verdicts and tags: a plain scan."""
    return read_parquet(spark, path) if path_exists(spark, path) else None


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The stored bias scores; a missing table has no models."""
    return read_or_empty(spark, path, schemas.BIAS_SCORES)


def read_text_table(
    spark: SparkSession, path: str, separator: str, columns: Sequence[str], multi_line: bool = False
) -> DataFrame:
    """Columns of a delimited file or folder as strings; damaged fields are kept as they are.

    Files are read in splits, with `multi_line=True` also where fields hold quoted line breaks, which takes
    a further scan and stores the columns.
    """
    if multi_line:
        return read_quoted_table(spark, path, separator, columns)
    table = (
        spark.read.option("sep", separator)
        .option("header", True)
        .option("inferSchema", False)
        .option("mode", "PERMISSIVE")
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return table.select(*[F.col(f"`{c}`") for c in columns])


def read_artworks(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_text_table(spark, path, "|", ARTWORK_COLUMNS, multi_line)


def read_venues(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_text_table(spark, path, ";", VENUE_COLUMNS, multi_line).withColumnsRenamed(VENUE_RENAMES)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """(position, id, completion) of a stored price list `{"data": [{id, pricing}, …]}`.

    The list is a file, or a folder of files that each hold a part of it and say in `offset` how many
    entries stand before theirs.  Files are read in parallel.
    """
    listing = spark.read.schema(schemas.PRICE_LIST).json(path, multiLine=True)
    return listing.select("offset", F.posexplode("data").alias("position", "item")).select(
        (F.coalesce("offset", F.lit(0)) + F.col("position")).cast("int").alias("position"),
        F.coalesce("item.id", F.lit("")).alias("id"), "item.pricing.completion"
    )


def write_prices(prices: DataFrame, path: str, rows: int = PRICES_PER_FILE) -> None:
    """Store (position, id, completion) in the order of the positions, which are whole and differ, as a
    folder for `read_prices`: one document for each range of `rows` positions."""
    parted = prices.withColumn("part", F.floor(F.col("position") / rows))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each document, so the window is small.
    offsets = parted.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    items = F.array_sort(F.collect_list(F.struct("position", "id", F.struct("completion").alias("pricing"))))
    documents = parted.groupBy("part").agg(
        F.transform(items, lambda x: F.struct(x["id"], x["pricing"])).alias("data")
    )
    documents.join(offsets, "part").select(
        "part", F.to_json(F.struct("offset", "data")).alias("value")
    ).write.partitionBy("part").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Write or replace a table; one that is there stays until the new one is complete."""
    publish(df, path)


def write_text_table(df: DataFrame, path: str, separator: str) -> None:
    """A delimited folder that `read_text_table` reads back unchanged."""
    (
        df.write.mode("overwrite")
        .option("sep", separator)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


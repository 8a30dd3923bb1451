"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Names that operators use for columns of their own.
CLASHING = ["size", "target", "taken", "kept", "quality", "n", "doc", "t1", "page", "host", "key", "label", "part",
            "bucket", "spans", "places", "shard", "id", "a", "b", "word", "__n"]


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    """doc_id, text, lang, source, n_chars from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(full, schema)
    if clashing:
        df = df.selectExpr("*", *[f"'x' AS {name}" for name in CLASHING if name not in df.columns])
    return df


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    letters = "etaoinshrdlu"
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))

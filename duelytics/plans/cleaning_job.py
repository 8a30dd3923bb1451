"""Raw tables → the five cleaned tables, written as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from duelytics.operators import cleaning
from duelytics.session import temporary
from duelytics.sources.arena import write_offsets
from duelytics.sources.files import path_exists, read_parquet
from duelytics.sources.publish import publishing


def run(
    spark: SparkSession, source: str, target: str, vote_key: str = "id", conv_key: str = "conversation_pair_id"
) -> list[str]:
    """Clean whichever of reactions, conversations and votes exist under `source`.

    Each output is one lazy plan from scan to write; all of them take their places together at the end, so
    the folder never holds tables of two runs.  The vote key stays in the arena table, the
    conversation key in the bias table; `sources.files.read_arena` numbers the arena's
    rows, and the offsets of its files are stored beside them for `sources.arena`.
    """

    jobs = {
        "reactions": (cleaning.RAW_NAMES, {"react": cleaning.build_react}),
        "conversations": (
            cleaning.RAW_NAMES,
            {
                "conv": cleaning.build_conv,
                "bias_conv": lambda df, names: cleaning.build_bias_conv(df, conv_key, names),
            },
        ),
        "votes": (
            cleaning.VOTE_NAMES,
            {
                "vot": cleaning.build_votes,
                "arena": lambda df, names: cleaning.build_arena(df, vote_key, names),
            },
        ),
    }
    written = []
    with temporary(spark), publishing(spark, target) as job:
        for table, (columns, builds) in jobs.items():
            path = f"{source}/{table}.parquet"
            if not path_exists(spark, path):
                continue
            raw = read_parquet(spark, path)
            names = cleaning.name_table(raw, columns)
            for output, build in builds.items():
                staged = job.write(build(raw, names), f"{output}.parquet")
                written.append(output)
                if output == "arena":
                    write_offsets(spark, staged)
    return written


if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--vote-key", default="id")
    parser.add_argument("--conv-key", default="conversation_pair_id")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    print(run(spark, args.source, args.target, args.vote_key, args.conv_key))

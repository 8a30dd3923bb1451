"""Headline timings: clean the raw tables once, then run the reports on the cleaned tables.

Prints one JSON line.  BENCH_SF_DIR is the table folder, BENCH_CPUS the number of cores,
BENCH_RUNS the number of measured runs per query (the median counts), after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duelytics import registry  # noqa: E402
from duelytics.plans import cleaning_job  # noqa: E402
from duelytics.session import local_session  # noqa: E402
from duelytics.sources import files  # noqa: E402

METRICS = [
    "model_metrics", "winrate", "ranking", "audience", "param_size", "satisfaction",
    "benchmarks_global", "model_badges", "price_per_token", "pick_rate", "topic_top_categories",
    "trend_join",
]
TEXTS = [
    "keyword_counts", "keyword_dicts", "top_artists", "coverage_artists", "coverage_venues",
    "tfidf_weights", "bias_scores", "sample_docs", "model_docs", "pair_turns",
    "parse_transcript",
]
ARENA = ["filter_pair", "explore_list", "verdict", "feedback_tags"]


class CleanedTables(registry.Tables):
    """Queries on the tables the cleaning step has written."""

    def __init__(self, spark, folder: str, cleaned: str):
        super().__init__(spark, folder)
        self.cleaned = cleaned

    def stored(self, name: str):
        return self.spark.read.parquet(f"{self.cleaned}/{name}.parquet")

    conv = property(lambda self: self.stored("conv"))
    votes = property(lambda self: self.stored("vot"))
    react = property(lambda self: self.stored("react"))
    arena = property(lambda self: files.read_arena(self.spark, f"{self.cleaned}/arena.parquet"))
    arena_path = property(lambda self: f"{self.cleaned}/arena.parquet")
    arena_rows = property(lambda self: files.read_duels(self.spark, f"{self.cleaned}/arena.parquet"))


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")

    scratch = tempfile.mkdtemp(prefix="duelytics-bench-")
    raw, cleaned = f"{scratch}/raw", f"{scratch}/cleaned"
    tables = CleanedTables(spark, folder, cleaned)
    for name, source in (("conversations", "duels"), ("votes", "duels"), ("reactions",) * 2):
        files.write_parquet(tables.raw(source), f"{raw}/{name}.parquet")

    def clean() -> None:
        cleaning_job.run(spark, raw, cleaned, vote_key="duel_id", conv_key="duel_id")

    builders = {
        **registry.metric_queries(), **registry.corpus_queries(), **registry.bias_queries(),
        **registry.explorer_queries(),
    }
    jobs = {"clean_job": clean}
    for key in [*METRICS, *TEXTS, *ARENA]:
        jobs[key] = lambda build=builders[key]: (
            build(tables).write.format("noop").mode("overwrite").save()
        )
    results = {}
    for key, job in jobs.items():
        job()
        results[key] = round(statistics.median(timed(job) for _ in range(runs)), 3)
        print(f"{key} {results[key]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()

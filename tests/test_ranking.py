import random

import pytest
from pyspark.sql import functions as F

from duelytics.functions.ranking import first_per_group, most_frequent


@pytest.mark.parametrize("n", [1, 10, 1500, 2000, 10_000])
def test_most_frequent(spark, n):
    rng = random.Random(1)
    data = [(f"t{i}", min(rng.randrange(1, 60) ** 2, 900)) for i in range(4000)]
    df = spark.createDataFrame(data, "term string, total long").repartition(5)
    got = most_frequent(df, "total", "term", n)
    assert [(r.term, r.total) for r in got.collect()] == sorted(data, key=lambda x: (-x[1], x[0]))[:n]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("term" in line for line in windows)  # only the histogram is ranked


@pytest.mark.parametrize("n", [1, 30, 2000])
def test_first_per_group(spark, n):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("model"), "id", F.md5(F.col("id").cast("string")).alias("tag"))
    expected = {}
    for r in df.collect():
        expected.setdefault(r.model, []).append((r.tag, r.id))
    got = {}
    for r in first_per_group(df, ["model"], "tag", ["id"], n).collect():
        got.setdefault(r.model, []).append((r.tag, r.id))
    assert {m: sorted(v) for m, v in got.items()} == {m: sorted(v)[:n] for m, v in expected.items()}


def test_nothing_to_rank(spark):
    assert most_frequent(spark.createDataFrame([], "term string, total long"), "total", "term", 5).count() == 0

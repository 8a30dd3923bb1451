"""Visitors from sketches beside the exact count."""

from datetime import datetime

from duelytics.constants import ALL_VERSIONS
from duelytics.operators import audience, metrics

SCHEMA = "visitor_id string, timestamp timestamp, base_model_a string, version_a string, base_model_b string, version_b string"


def duels(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(table):
    return {(r.family, r.version): r.estimate for r in table.collect()}


def exact(conv):
    return {(r.family, r.version): r.visitors for r in metrics.audience(conv).collect()}


def test_small_counts_are_exact(spark):
    day = datetime(2025, 3, 5)
    conv = duels(spark, [
        (None, day, "x", "1", "y", ""), (None, None, "x", "1", "y", "2"), ("", day, "x", "2", "x", "1"),
        ("none", day, "x", None, "y", "2"), ("a", day, "x", "1", "x", "1"), ("a", datetime(2025, 4, 1), "x", "2", "y", "2"),
    ])
    assert found(audience.estimated(audience.sketches(conv))) == exact(conv)


def test_large_counts_are_close(spark):
    conv = spark.range(60_000).selectExpr(
        "cast(id % 40000 AS string) AS visitor_id", "timestamp'2025-01-01' + make_interval(0, cast(id % 12 AS int)) AS timestamp",
        "'x' AS base_model_a", "cast(id % 2 AS string) AS version_a", "'y' AS base_model_b", "'z' AS version_b")
    near = found(audience.estimated(audience.sketches(conv)))
    for model, visitors in exact(conv).items():
        assert abs(near[model] - visitors) <= audience.MOST_OFF * visitors


def test_months_and_merge(spark):
    old = duels(spark, [("a", datetime(2025, 1, 31), "x", "1", "y", "1"), ("b", datetime(2025, 2, 1), "x", "1", "y", "1")])
    new = duels(spark, [("b", datetime(2025, 2, 9), "x", "1", "y", "1"), ("c", datetime(2025, 3, 1), "x", "1", "y", "1")])
    table = audience.merged(audience.sketches(old), audience.sketches(new))
    assert table.count() == 6
    assert found(audience.estimated(table))["x", ALL_VERSIONS] == 3
    assert found(audience.estimated(table, "2025-02-01"))["x", "1"] == 2
    assert found(audience.estimated(table, until="2025-02-01"))["x", "1"] == 2
    again = audience.merged(table, audience.sketches(new))
    assert found(audience.estimated(again)) == found(audience.estimated(table))


def test_no_duels(spark):
    assert audience.estimated(audience.sketches(duels(spark, []))).count() == 0

"""Registered queries beside their SQL on the smallest tables.

A representative part by default; all of them with DUELYTICS_ALL_CHECKS=1.
"""

import os

import pytest

import __spark_entry__ as spark_entry
from duelytics import registry
from tests.conftest import SF
from tools.check import compare, oracle_connection

PART = [
    "winner_normalize", "build_arena", "build_bias_conv", "build_react", "model_metrics",
    "ranking", "price_per_token", "topic_top_categories", "trend_join", "model_docs",
    "sample_docs", "keyword_counts", "tfidf_weights", "tfidf_communs", "coverage_artists",
    "bias_scores", "bias_deltas", "explore_list", "parse_transcript", "pair_turns",
    "bias_job", "arena_row_id", "src_prices", "tfidf_discriminants", "filter_result_draw",
]
QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()
KEYS = list(registry.queries()) if os.environ.get("DUELYTICS_ALL_CHECKS") else PART


def test_every_query_has_sql():
    assert set(ORACLES) <= set(QUERIES)
    assert set(registry.queries()) <= set(ORACLES)


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, key):
    assert compare(QUERIES[key](spark, SF), con, ORACLES[key]) is None


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["family", "winrate", "position", "n", "progress"]
    assert sorted(r.position for r in df.collect()) == list(range(1, df.count() + 1))

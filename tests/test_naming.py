from pyspark.sql import functions as F

from duelytics.constants import BAD_NAMES, JUNK_PREFIXES
from duelytics.derived import NAME_POOL
from duelytics.functions.naming import family_of, is_bad, is_junk, version_of
from duelytics.operators import cleaning

EXPECTED = {
    "gpt-4o-mini-2024-07-18": ("gpt", "4o-mini"),
    "gpt-4.1-mini": ("gpt", "4.1-mini"),
    "claude-3-5-sonnet-v2": ("claude", "3-5-sonnet"),
    "claude-4-5-sonnet": ("claude", "4-5-sonnet"),
    "mistral-large-2411": ("mistral", "large-2411"),
    "Llama-3.1-405B": ("llama", "3.1-405B"),
    "mixtral-8x22b-instruct-v0.1": ("mixtral", "8x22b-instruct"),
    "o3-mini": ("", "o3-mini"),
    "gemma-3-27b": ("gemma", "3-27b"),
    "gemini-2.0-flash": ("gemini", "2.0-flash"),
    "deepseek-r1-distill-llama-70b": ("llama", "r1-distill"),
    "deepseek-v3-chat": ("deepseek", "v3-chat"),
    "phi-4": ("phi", "4"),
    "qwq-32b": ("qwen", "32b"),
    "command-a": ("command", "a"),
    "c4ai-command-r-08-2024": ("c4ai-command-r", "08-2024"),
    "aya-expanse-8b": ("aya", "expanse-8b"),
    "gpt-oss-120b": ("gpt", "oss-120b"),
    "gpt_4_1": ("gpt", ""),
    "abc-12": ("abc", "12"),
    "magistral-medium": ("magistral", "medium"),
    "lfm-40b": ("lfm", "40b"),
    "hermes-3-llama-3.1-405b": ("hermes", "3-llama-3.1-405b"),
    "jamba-1.5-large": ("jamba", "1.5-large"),
    "glm-4.5": ("glm", "4.5"),
    "grok-3-mini-beta": ("grok", "3-mini"),
    "ministral-8b-instruct-2410": ("ministral", "8b-instruct"),
    "yi-1.5-34b-chat": ("yi", "1.5-34b-chat"),
    "qwen2.5-coder-32b-instruct": ("qwen", "5-coder-32b"),
    "EuroLLM-9B": ("eurollm", "9B"),
}


def named(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_pool_is_covered():
    junk = {n for n in NAME_POOL if n.startswith(tuple(JUNK_PREFIXES))}
    assert len(junk) == len(JUNK_PREFIXES) and len(set(NAME_POOL) & set(BAD_NAMES)) == 2
    assert set(NAME_POOL) - junk - set(BAD_NAMES) <= set(EXPECTED)


def test_family_and_version(spark):
    out = named(spark, EXPECTED).select(
        "name",
        F.btrim(family_of(F.col("name")), F.lit("-")),
        F.btrim(version_of(F.col("name")), F.lit("-")),
    )
    got = {r[0]: (r[1], r[2]) for r in out.collect()}
    assert got == EXPECTED


def test_null_name_stays_null(spark):
    out = named(spark, [None]).select(family_of(F.col("name")), version_of(F.col("name"))).first()
    assert tuple(out) == (None, None)


def test_junk_and_bad(spark):
    names = ["javascript:x", "'quoted", "<b>", "none", "gpt-4", "my<b>"]
    out = named(spark, names).select("name", is_junk(F.col("name")), is_bad(F.col("name")))
    assert [tuple(r)[1:] for r in out.collect()] == [
        (True, False), (True, False), (True, False), (False, True), (False, False), (False, False),
    ]


def test_name_table_equals_expressions(spark, rows):
    pairs = [(a, b, a, 1) for a in NAME_POOL for b in NAME_POOL] + [
        (None, "gpt-4", None, 1), ("gpt-4", "phi-4", None, 1), ("gpt-4", "phi-4", "phi-4", 0),
    ]
    df = spark.createDataFrame(
        pairs, "model_a_name string, model_b_name string, chosen_model_name string, conv_turns int"
    )
    names = cleaning.name_table(df, cleaning.VOTE_NAMES)
    slow = cleaning.normalize_winner(cleaning.normalize_models(df))
    fast = cleaning.normalize_winner(cleaning.normalize_models(df, names), names)
    assert rows(slow) == rows(fast)
    assert len(rows(slow)) == (len(NAME_POOL) - 1) ** 2 + 1  # one name has no family


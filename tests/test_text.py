import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from duelytics.dictionaries import CONVERSATION_SIDE, keyword_set
from duelytics.functions import matching
from duelytics.functions.matching import keyword_hits, names_in_texts
from duelytics.functions.numeric import round_even
from duelytics.functions.text import (
    clean_text, conversation_text, keyword_pattern, native_transcript, parse_transcript,
)
from duelytics.operators import corpus

KEYWORDS = ["art", "art nouveau", "moyen-âge", "âge", "centre d'art", "d'art", "xxe siècle", "éa", "é"]


def brute(text, keywords):
    ordered = sorted(keywords, key=len, reverse=True)
    return len(re.findall(r"\b(?:" + "|".join(map(re.escape, ordered)) + r")\b", text))


TEXTS = [
    "art art nouveau, l'art moyen-âge", "centre d'art et d'art nouveau", "artéa éa é xéa", "", None,
    "moyen-âge-âge xxe siècle; xxe  siècle", "art_art art1 1art art", "É é éé art",
]


@pytest.mark.parametrize("keywords", [KEYWORDS, ["art"], ["é", "éa"], ["d'art", "centre d'art", "art"]])
def test_keyword_hits_equal_regex(spark, keywords):
    docs = spark.createDataFrame([("m", t) for t in TEXTS], "model string, text string").repartition(3)
    row = keyword_hits(docs, [keywords]).first()
    counts = [brute(t or "", keywords) for t in TEXTS]
    assert (row.hits, row.texts) == (sum(counts), sum(c > 0 for c in counts))
    pattern = keyword_pattern(keywords)
    by_sql = docs.select(F.sum(F.regexp_count("text", F.lit(pattern)))).first()[0]
    assert by_sql == sum(counts)


def test_keyword_hits_random(spark):
    @settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet="aé -'1_b", max_size=25), min_size=1, max_size=20),
           st.lists(st.from_regex(r"[aéb1]([aé \-'b]{0,3}[aéb1])?", fullmatch=True), min_size=1, max_size=6))
    def check(texts, keywords):
        docs = spark.createDataFrame([("m", t) for t in texts], "model string, text string")
        row = keyword_hits(docs, [keywords, ["a"]]).filter("index = 0").first()
        assert row.hits == sum(brute(t, keywords) for t in texts)

    check()


def test_keyword_counts_have_zero_rows(spark):
    docs = spark.createDataFrame([("m", "paris et lyon, paris"), ("n", "rien")], "model string, text string")
    out = corpus.keyword_counts(docs, CONVERSATION_SIDE)
    assert out.count() == 2 * 34
    hits = {(r.model, r.category): r.hits for r in out.filter("hits > 0").collect()}
    assert hits == {("m", "Île-de-France"): 2, ("m", "Auvergne-Rhône-Alpes"): 1}


def test_names_are_substrings(spark, rows):
    docs = spark.createDataFrame(
        [("m", "le durandal"), ("m", "durand"), ("n", "vinci, léonard"), ("n", None)], "model string, text string")
    out = names_in_texts(docs, listed(spark, {"x": ["durand", "vinci"], "y": ["vinci", "absent"]}))
    assert rows(out, "model", "kind", "name") == [("m", "x", "durand"), ("n", "x", "vinci"), ("n", "y", "vinci")]
    assert names_in_texts(docs, listed(spark, {"x": []})).count() == 0


def listed(spark, lists):
    return spark.createDataFrame([(k, n) for k, names in lists.items() for n in names], "kind string, name string")


def test_names_across_pieces_and_beyond_the_basic_plane(spark, rows, monkeypatch):
    monkeypatch.setattr(matching, "PIECE", 7)
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab𝒜é \n'", k=rng.randint(0, 60))) for _ in range(80)]
    names = {t[i : i + n] for t in texts for i, n in [(rng.randrange(60), rng.randint(1, 12)) for _ in range(4)]}
    names = sorted(x for x in names if x) + ["absent name", "a'b'a'b'a'b"]
    docs = spark.createDataFrame([(str(i % 9), t) for i, t in enumerate(texts)], "model string, text string")
    expected = {(str(i % 9), "k", n) for i, t in enumerate(texts) for n in names if n in t}
    assert rows(names_in_texts(docs, listed(spark, {"k": names})), "model", "kind", "name") == sorted(expected, key=repr)


def test_more_names_than_the_map_can_tell_apart(spark, rows):
    docs = spark.createDataFrame([("m", "xx name 00017 and name 149999, name 15000")], "model string, text string")
    names = spark.range(150_000).selectExpr("'k' AS kind", "format_string('name %05d', id) AS name")
    expected = {f"name {i:05d}" for i in range(150_000)}
    text = "xx name 00017 and name 149999, name 15000"
    assert rows(names_in_texts(docs, names), "name") == sorted(((n,) for n in expected if n in text), key=repr)


def test_keyword_set_is_the_union():
    words = keyword_set()
    assert len(words) == len(set(words)) and {"paris", "gothique", "peinture", "cinéma"} <= set(words)
    assert "roman" not in words


def test_clean_text(spark):
    df = spark.createDataFrame([(" \t Musée \n",), ("  ",), (None,)], "v string")
    assert [r[0] for r in df.select(clean_text(F.col("v"))).collect()] == ["musée", None, None]


def test_conversation_text(spark):
    df = spark.sql("""SELECT array(named_struct('role','user','content','Bonjour'),
        named_struct('role','x','content',CAST(NULL AS STRING)),
        named_struct('role','assistant','content','ÇA')) c UNION ALL SELECT NULL""")
    assert sorted(r[0] for r in df.select(conversation_text(F.col("c"))).collect()) == ["", "bonjour  ça"]


TRANSCRIPTS = [
    ("[{'role': 'user', 'content': 'bonjour'}]", [("user", "bonjour")]),
    ("[{'role': 'user', 'content': \"l'art\"}]", []),
    ("oops", []),
    ("{'role':'user','content':'x'}", []),
    ("[1,{'role':'user','content':'x'}]", [("user", "x")]),
    ("[{'role':'user'}]", [("user", "")]),
    (None, []),
    ("[]", []),
    ("  [{'content':'seul'}] ", [("", "seul")]),
    ("[{'role':'user','content':'x'}] junk", []),
    ('["{a}"]', []),
    ("['{a}', null, [1], {'content':'x'}]", [("", "x")]),
]


def test_parse_transcript(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TRANSCRIPTS)], "i int, t string")
    got = {r.i: [tuple(m) for m in r.m] for r in df.select("i", parse_transcript(F.col("t")).alias("m")).collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(TRANSCRIPTS)}


def test_native_transcript(spark):
    df = spark.sql("SELECT array(named_struct('role','user','content',CAST(NULL AS STRING)), NULL) c")
    assert [tuple(m) for m in df.select(native_transcript(F.col("c"))).first()[0]] == [("user", "")]


def test_cultural_filter(spark, rows):
    df = spark.createDataFrame(
        [(1, ["SMART tech"], None), (2, None, ["MUSÉE"]), (3, ["sport"], ["foot"]), (4, None, None),
         (5, [None, "Théâtre"], [])], "i int, categories array<string>, keywords array<string>")
    assert rows(corpus.cultural_filter(df), "i") == [(1,), (2,), (5,)]


def test_model_docs_and_sample(spark, rows):
    message = "array(named_struct('role','user','content','{}'))"
    df = spark.sql(f"""SELECT id, 'x' base_model_a, 'y' base_model_b, {message.format('Texte A')} conversation_a,
        IF(id = 0, {message.format(' ')}, {message.format('Texte B')}) conversation_b FROM range(40)""")
    docs = corpus.model_docs(df, "id")
    assert rows(docs.groupBy("model").count(), "model", "count") == [("x", 40), ("y", 39)]
    once, again = (corpus.sample_docs(docs.repartition(k), 7, keys=("doc_id", "side")) for k in (2, 9))
    assert rows(once) == rows(again)
    assert rows(once.groupBy("model").count(), "model", "count") == [("x", 7), ("y", 7)]
    assert rows(corpus.sample_docs(docs, 100, keys=("doc_id", "side"))) == rows(docs)


def test_round_even(spark):
    values = [2.5, 3.5, -2.5, -0.2, 0.125, 1e9 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_even(F.col("x"), 0)).collect()]
    assert got == [2.0, 4.0, -2.0, 0.0, 0.0, 1e9] and str(got[3]) == "0.0"
    assert spark.range(1).select(round_even(F.lit(0.125), 2)).first()[0] == round(0.125, 2)


def test_name_search_hands_on_little(spark, tmp_path):
    """A long name elsewhere in the list must not widen what goes with every gram of a text."""
    docs = spark.range(50).selectExpr("'m' AS model", "concat('x', id, repeat(' vieux louvre du soir', 200)) AS text")
    found = names_in_texts(docs, listed(spark, {"k": ["vieux louvre", "long name " * 500]}))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
    assert [(r["name"], r.kind, r.model) for r in found.collect()] == [("vieux louvre", "k", "m")]

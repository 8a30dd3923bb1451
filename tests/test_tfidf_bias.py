import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duelytics import registry, schemas
from duelytics.dictionaries import PERIODS_REF
from duelytics.functions import terms, text
from duelytics.functions.text import keyword_pattern
from duelytics.operators import bias, catalogue, tfidf
from duelytics.plans import bias_job

DOCS = [
    ("a", "le musée de paris, le musée"), ("a", "paris paris château"),
    ("b", "le château de versailles"), ("b", "un musée à lyon"),
    ("c", "le louvre et paris"), ("d", "rien du tout le soir"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "model string, text string").repartition(3)


def brute_weights(min_df=2, max_df=0.85):
    counts = {}
    for model, text in DOCS:
        words = re.findall(r"\b\w\w+\b", text)
        counts.setdefault(model, Counter()).update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter(t for c in counts.values() for t in c)
    vocabulary = {t for t, n in df.items() if min_df <= n <= max_df * len(counts)}
    out = {}
    for model, c in counts.items():
        raw = {t: c[t] * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t in vocabulary if c[t]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(model, t): v / norm for t, v in raw.items()})
    return out


def test_weights(docs):
    got = {(r.model, r.term): r.weight for r in tfidf.tfidf_weights(docs).collect()}
    assert got == pytest.approx(brute_weights())


def test_feature_cap_prefers_frequent_terms(docs):
    got = [r.term for r in tfidf.tfidf_vocabulary(docs, max_features=2).orderBy(F.desc("total"), "term").collect()]
    totals, models = Counter(), {}
    for model, text in DOCS:
        words = re.findall(r"\w\w+", (text or "").lower())
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            totals[term] += 1
            models.setdefault(term, set()).add(model)
    n = len({m for m, _ in DOCS})
    kept = [t for t in totals if 2 <= len(models[t]) <= 0.85 * n]
    assert got == sorted(kept, key=lambda t: (-totals[t], t))[:2]


def test_two_models_leave_nothing(spark):
    docs = spark.createDataFrame([("a", "un deux"), ("b", "un deux")], "model string, text string")
    assert tfidf.tfidf_weights(docs).count() == 0
    lists = tfidf.tfidf_top_terms(docs, ["un"]).collect()
    assert all(r.discriminants == [] and r.communs == [] for r in lists) and len(lists) == 2


def test_top_terms(docs):
    keywords = ["musée", "paris", "château", "absent"]
    got = {r.model: (r.discriminants, r.communs) for r in tfidf.tfidf_top_terms(docs, keywords).collect()}
    weights = brute_weights()
    for model in "abcd":
        used = [k for k in keywords if (model, k) in weights]
        known = {t for _, t in weights} & set(keywords)
        assert got[model][0] == sorted(used, key=lambda k: (-weights[model, k], k))
        assert got[model][1] == sorted(known - set(used))


def test_shares_are_counted_once(spark):
    tables = registry.Tables(spark, "/root/testdata/sf0.001")
    assert tables.pairs is tables.pairs
    plan = tables.measures._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "RLIKE" not in plan  # texts and catalogues are not read for them again


def test_edges_of_catalogue_keywords(spark):
    texts = ["a-b", "xa-b", "[c", "x[c", "été", "pété", "d e", "d  e", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for keywords in (["a-b"], ["[c", "^", "]x"], ["été", "d e"], ["-b", "a-"]):
        plain = df.select(F.rlike("t", F.lit(keyword_pattern(keywords)))).collect()
        assert df.select(catalogue.mentions_any("t", keywords)).collect() == plain


def test_reference_counts(spark):
    texts = ["Fin du 19e siècle, art nouveau", "20E SIÈCLE", None, "  ", "19e siècle", "romans"]
    df = spark.createDataFrame([(t,) for t in texts], "Periode_de_creation string")
    out = catalogue.reference_counts(df, {"Periode_de_creation": ("periods", PERIODS_REF)})
    got = {r.category: r.hits for r in out.collect()}
    assert len(got) == 7 and got["XIXe siècle"] == 2 and got["XXe siècle"] == 1 and sum(got.values()) == 3
    pct = {r.category: r.pct for r in catalogue.distribution(out).collect()}
    assert pct["XIXe siècle"] == 66.7 and pct["XXe siècle"] == 33.3 and pct["Renaissance"] == 0.0
    none = catalogue.distribution(
        catalogue.reference_counts(df.limit(0), {"Periode_de_creation": ("periods", PERIODS_REF)}))
    assert {r.pct for r in none.collect()} == {0.0} and none.count() == 7


def test_names_and_coverage(spark):
    artists = ["Monet, Claude; Manet Édouard", "monet/Manet édouard", " , ", None, "Rodin,  auguste rodin "]
    df = spark.createDataFrame([(t,) for t in artists], "Auteur string")
    names = catalogue.top_artists(df)
    got = [(r["name"], r.n) for r in names.collect()]
    assert got == [("manet édouard", 2), ("auguste rodin", 1), ("claude", 1)]
    assert [r["name"] for r in catalogue.top_artists(df, k=1).collect()] == ["manet édouard"]
    docs = spark.createDataFrame([("m", "claudel, manet édouard"), ("n", "x")], "model string, text string")
    cover = {r.model: (r.matched, r.coverage) for r in catalogue.coverage_artists(docs, names).collect()}
    assert cover == {"m": (2, 2.0), "n": (0, 0.0)}
    wide = {r.model: r.coverage for r in catalogue.coverage(docs, names, 0.5).collect()}
    assert wide == {"m": 1.3, "n": 0.0}
    venues = spark.createDataFrame([("Le Louvre",), ("le louvre",), ("court",), ("Archives",)], "Nom string")
    assert [(r["name"], r.n) for r in catalogue.top_venues(venues).collect()] == [("le louvre", 2), ("archives", 1)]


BIAS = [
    ("m1", 40.0, 45.0, 55.0, 10.0, 30.0, 25.0),
    ("m2", 20.0, 10.0, 5.0, 30.0, 10.0, 5.0),
    ("m3", 35.0, 40.0, 50.0, 15.0, 25.0, 20.0),
]
EXPECTED_BADGES = {
    "m1": (["Obsession Moyen Âge", "Art moderne sous-cité", "Fort biais historique"],
           ["Parisiano-centrisme", "Biais spectacle vivant", "Invisibilisation des régions"]),
    "m2": (["Adéquation historique OK"], ["Score standard"]),
    "m3": (["Fort biais historique"], ["Invisibilisation des régions"]),
}


@pytest.fixture
def scored(spark):
    pair = "named_struct('ia', CAST({} AS DOUBLE), 'ref', CAST(1 AS DOUBLE))"
    rows = [
        f"""SELECT '{m}' model, CAST({a} AS DOUBLE) artworks_score, 12.5D artworks_coverage,
        map('Moyen Âge', {pair.format(mid)}, 'XXe siècle', {pair.format(mod)}) periods,
        map('Peinture', 1.5D) domains, CAST({v} AS DOUBLE) venues_score, 60.0D venues_coverage,
        map('Île-de-France', {pair.format(idf)}) regions, map('Théâtres & Opéras', {pair.format(th)}) types,
        array('é"t') discriminants, CAST(array() AS ARRAY<STRING>) communs"""
        for m, a, v, mid, mod, idf, th in BIAS
    ]
    return spark.sql(" UNION ALL ".join(rows))


def test_bias_badges(scored):
    got = {r.model: (r.artworks_badges, r.venues_badges) for r in bias.bias_badges(scored).collect()}
    assert got == EXPECTED_BADGES


def test_store_and_read_back(spark, scored, tmp_path, rows):
    stored = bias.encode_scores(scored)
    assert set(stored.columns) == {f.name for f in schemas.BIAS_SCORES}
    path = str(tmp_path / "scores.parquet")
    stored.write.parquet(path)
    back = bias.bias_rows(spark.read.parquet(path))
    assert {r.model: (r.artworks_badges, r.venues_badges) for r in back.collect()} == EXPECTED_BADGES
    columns = [c for c in scored.columns]
    assert rows(bias.decode_scores(stored), *columns) == rows(scored, *columns)
    assert '"Moyen Âge"' in stored.first().joconde_periodes


def test_missing_values_read_as_empty(spark):
    empty = spark.createDataFrame([("m", *[None] * 10)], schemas.BIAS_SCORES)
    row = bias.bias_rows(empty).first()
    assert row.periods == {} and row.communs == [] and row.artworks_score == 0.0
    assert row.artworks_badges == ["Art moderne sous-cité", "Adéquation historique OK"]
    assert row.venues_badges == ["Score standard"]


def test_means_deltas_grades(scored):
    means = bias.bias_means(scored).first()
    assert tuple(means) == (31.67, 12.5, 31.67, 60.0)
    assert tuple(bias.bias_means(scored.limit(0)).first()) == (0.0,) * 4
    deltas = {r.model: r.artworks_score_delta for r in bias.bias_deltas(scored).collect()}
    assert deltas["m1"] == pytest.approx(8.33)
    grades = {r.model: tuple(r)[1:] for r in bias.bias_grades(scored).collect()}
    assert grades == {"m1": ("red", "red", "red", "green"), "m2": ("green", "red", "green", "green"),
                      "m3": ("amber", "red", "red", "green")}


def test_gap_classes(spark):
    data = [("m", "periods", "x", 0, 10.0, 7.0), ("m", "periods", "y", 1, 10.1, 7.0),
            ("m", "types", "z", 0, 1.0, 4.1), ("m", "domains", "u", 0, 9.0, 4.0),
            ("m", "domains", "v", 1, 1.0, 6.1)]
    pairs = spark.createDataFrame(data, "model string, dict string, category string, rank int, ia double, ref double")
    got = {r.category: (r.gap, r["class"]) for r in bias.gap_classes(pairs).collect()}
    assert got == {"x": (3.0, "neutral"), "y": (3.1, "over"), "z": (-3.1, "under"),
                   "u": (5.0, "neutral"), "v": (-5.1, "under")}


def test_score_is_capped(spark):
    gaps = spark.createDataFrame([("m", "periods", 60.0), ("m", "domains", 40.0), ("n", "periods", 1.0)],
                                 "model string, dict string, mae double")
    assert {r.model: r.artworks_score for r in bias.score_artworks(gaps).collect()} == {"m": 100.0, "n": 1.2}


def test_whole_job(spark, tmp_path):
    message = "array(named_struct('role', 'user', 'content', '{}'))"
    cases = [("gpt", "phi", "Le musée du Louvre à Paris, art gothique", "claude monet à versailles"),
             ("phi", "yi", "le château de lyon, peinture", "musée et peinture à paris"),
             ("yi", "gpt", "impressionnisme et peinture", "le musée de lyon")]
    duels = spark.sql(" UNION ALL ".join(
        f"""SELECT {i} conversation_pair_id, '{a}' base_model_a, '{b}' base_model_b,
        {message.format(x)} conversation_a, {message.format(y)} conversation_b,
        array('Art & culture') categories, array('x') keywords""" for i, (a, b, x, y) in enumerate(cases)))
    duels.write.parquet(str(tmp_path / "bias_conv.parquet"))
    (tmp_path / "art.csv").write_text(
        "Auteur|Domaine|Periode_de_creation|Region|Nom_officiel_musee|x\n"
        "Claude Monet;Rodin Auguste|peinture|19e siècle|IDF|Orsay|1\n"
        "Claude Monet|Sculpture|12e siècle|IDF|Louvre\n", encoding="utf8")
    (tmp_path / "lieux.csv").write_text(
        "Nom;Type équipement ou lieu;Domaine;Région;Département;libelle_geographique;x\n"
        "Musée du Louvre;Musée;d;Île-de-France;75;Paris;1\n"
        "Opéra de Lyon;Opéra;d;Auvergne-Rhône-Alpes;69;Lyon;2\n", encoding="utf8")
    out = str(tmp_path / "scores.parquet")
    bias_job.run(spark, str(tmp_path / "bias_conv.parquet"), str(tmp_path / "art.csv"),
                 str(tmp_path / "lieux.csv"), out)
    stored = spark.read.parquet(out)
    assert all(r.joconde_periodes.startswith('{"Moyen Âge":{"ia":') for r in stored.collect())
    rows = {r.model: r for r in bias.bias_rows(stored).collect()}
    assert set(rows) == {"gpt", "phi", "yi"}
    assert rows["phi"].artworks_coverage == 1.0 and rows["yi"].artworks_coverage == 0.0
    assert rows["gpt"].periods["Moyen Âge"].ia == 100.0 and rows["gpt"].periods["Moyen Âge"].ref == 50.0
    assert rows["gpt"].regions["Île-de-France"].ia == 66.7
    assert rows["gpt"].types["Musées"].ref == 50.0


def test_rare_terms_are_not_counted(spark):
    """Words that occur once are as many as there are words; they and their pairs take no row of the counts."""
    rng = random.Random(5)
    texts = [(f"m{i % 7 if i % 3 else 0}", " ".join(
        [rng.choice(["le musée", "é à", "du 5 soir", "_x9 l'art", "ÉTÉ\nété", f"mot{rng.randrange(40)}"]) for _ in range(30)]
        + [f"seul{i}n{k}" for k in range(60)])) for i in range(120)] + [("m1", None), ("m2", ""), (None, "le musée")]
    docs = spark.createDataFrame(texts, "model string, text string").repartition(5)
    limits = {"max_features": 10, "min_df": 2, "max_df": 0.95}
    every, few = tfidf.term_counts(docs), tfidf.frequent_term_counts(docs, **limits)
    assert few.count() < every.count() / 4
    assert few.exceptAll(every).count() == 0
    order = [F.desc("total"), "term"]
    expected = tfidf.tfidf_vocabulary(docs, every, **limits).orderBy(*order).collect()
    assert len(expected) == 10 and tfidf.tfidf_vocabulary(docs, **limits).orderBy(*order).collect() == expected


def test_terms_of_all_models_do_not_widen_the_count(spark, monkeypatch):
    """The most frequent terms are in all models; what the vocabulary takes is rarer and still counted in one pass."""
    rng = random.Random(6)
    texts = [(f"m{i % 8}", " ".join(
        [f"tous{k}" for k in range(300)] + [f"né{(i % 8) // 2}é{k % 4}" for k in range(12)]
        + [f"seul{rng.randrange(10**9)}" for _ in range(100)])) for i in range(64)] + [("m1", None), (None, "né0é1")]
    docs = spark.createDataFrame(texts, "model string, text string").repartition(3)
    limits = {"max_features": 6, "min_df": 2, "max_df": 0.85}
    calls, plain = [], tfidf.counts_in_buckets
    monkeypatch.setattr(tfidf, "counts_in_buckets", lambda *args: calls.append(1) or plain(*args))
    every, few = tfidf.term_counts(docs), tfidf.frequent_term_counts(docs, **limits)
    assert len(calls) == 1 and few.count() < 100 and few.exceptAll(every).count() == 0
    order = [F.desc("total"), "term"]
    expected = tfidf.tfidf_vocabulary(docs, every, **limits).orderBy(*order).collect()
    assert len(expected) == 6 and tfidf.tfidf_vocabulary(docs, few, **limits).orderBy(*order).collect() == expected


def test_hashes_count_as_terms_do(spark, monkeypatch):
    """Counts, models and limits by hash are those of the strings, also if a task hands on its hashes often."""
    rng = random.Random(7)
    texts = [(rng.choice(["a", "b", "c", "d", None]), " ".join(f"é{rng.randrange(k)}" for k in range(1, 60))) for _ in range(80)]
    texts += [("a", ""), ("b", None), ("c", "x y"), ("d", "seul"), ("nothing", ", x"), ("e", "")]
    docs = spark.createDataFrame(texts, "model string, text string").repartition(4)
    monkeypatch.setattr(terms, "HASHES", 500)
    every = tfidf.term_counts(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    expected = sorted(r.total for r in every.filter("df BETWEEN 2 AND 4").collect())
    got = terms.fitting_buckets(terms.spaced(docs), 10**6, 2, 4.0)
    assert sorted(r.total for r in got.collect()) == expected and len(expected) > 100
    top = sorted((r.total for r in terms.fitting_buckets(terms.spaced(docs), 5, 2, 4.0).collect()), reverse=True)
    assert top[:5] == expected[::-1][:5]
    assert terms.fitting_buckets(terms.spaced(docs.limit(0)), 5, 2, 4.0).count() == 0


def test_all_terms_are_counted_when_few_fit(spark):
    docs = spark.createDataFrame(DOCS + [("e", "a bb 7 ccc  dd"), (None, "bb")], "model string, text string")
    every = tfidf.term_counts(docs).collect()
    assert sorted(tfidf.frequent_term_counts(docs, max_features=1, min_df=99).collect(), key=repr) == sorted(every, key=repr)


def test_keywords_inside_words_do_not_count(spark):
    df = spark.createDataFrame([("Lande",), ("la  lande",), ("l'art",), (None,), ("c++x",)], "v string")
    out = catalogue.reference_counts(df, {"v": ("d", {"x": ["la"], "y": ["art", "land"], "z": ["++", "zz"]})})
    assert {r.category: r.hits for r in out.collect()} == {"x": 1, "y": 1, "z": 1}


def test_a_keyword_is_found_by_its_letters_first(spark):
    """The letters lead the pattern, so that a text is not tried at every character; the texts are those of the list."""
    assert text.found_keyword_pattern("d'art").startswith(r"d\'art") and text.found_keyword_pattern("++").startswith(r"\+\+")
    rng = random.Random(8)
    keywords = ["la", "l'art", "art la", "++", "é", "a+", "_x"]
    texts = [("".join(rng.choices([*keywords, "x", "७", " ", "\n", "-", "'"], k=rng.randint(0, 6))),) for _ in range(600)]
    df = spark.createDataFrame(texts + [(None,), ("xla la",), ("lala-la",)], "v string")
    lists = [[k] for k in keywords] + [keywords[:3], keywords]
    got = df.agg(*[F.count_if(catalogue.mentions_any("v", k)).alias(f"c{i}") for i, k in enumerate(lists)]).first()
    expected = df.agg(*[F.count_if(F.rlike("v", F.lit(text.keyword_pattern(k)))).alias(f"c{i}") for i, k in enumerate(lists)]).first()
    assert got == expected and 0 < min(got) and max(got[:7]) < 400


def test_names_of_blank_and_spaced_cells(spark):
    cells = [(None,), ("",), (" \t\u3000",), ("  Claude MONET ; RODIN auguste",), ("claude monet/x",), ("Élan Vital,,",), (" İstanbul ",)]
    df = spark.createDataFrame(cells, "Auteur string")
    got = {r.name: r.n for r in catalogue.top_artists(df).collect()}
    assert got == {"claude monet": 2, "rodin auguste": 1, "élan vital": 1, "i̇stanbul": 1}

import json

import pytest
from pyspark.sql import functions as F

from duelytics import derived, schemas, session
from duelytics.operators import explorer
from duelytics.sources import files

ARENA = ("arena_id long, base_model_a string, version_a string, base_model_b string, version_b string,"
         " chosen_base_model string, both_equal boolean, selected_category string, conv_turns int,"
         " opening_msg string, timestamp timestamp_ntz")
DUELS = [
    (0, "gpt", "4", "phi", "4", "gpt", False, "art", 1, "x" * 131, None),
    (1, "phi", "4", "gpt", "5", "gpt", None, "art", 2, "  ", None),
    (2, "gpt", "4", "gpt", "5", "gpt", True, "sport", 3, None, None),
    (3, "yi", "", "phi", "3", None, False, "", 4, "court", None),
    (4, "yi", "", "gpt", "4", "yi", False, None, 9, "y" * 130, None),
]


@pytest.fixture
def arena(spark):
    return spark.createDataFrame(DUELS, ARENA)


def ids(df):
    return sorted(r.arena_id for r in df.collect())


@pytest.mark.parametrize("filters, expected", [
    ({}, [0, 1, 2, 3, 4]),
    ({"m1": "gpt", "m2": "phi"}, [0, 1]),
    ({"m2": "yi"}, [3, 4]),
    ({"m1": "gpt", "v1": "4"}, [0, 2, 4]),
    ({"v1": "4"}, [0, 1, 2, 3, 4]),
    ({"m1": "gpt", "v1": "5", "m2": "phi", "v2": "4"}, [1]),
    ({"categories": ["art", "sport"]}, [0, 1, 2]),
    ({"result": "draw"}, [2]),
    ({"result": "m1"}, [0, 1, 2, 3, 4]),
    ({"m1": "gpt", "result": "m1"}, [0]),
    ({"m1": "gpt", "m2": "yi", "result": "m2"}, [4]),
    ({"turns": "1"}, [0]), ({"turns": "2-3"}, [1, 2]), ({"turns": "4+"}, [3, 4]),
])
def test_filters(arena, filters, expected):
    assert ids(explorer.explore(arena, **filters)) == expected


def test_choice_lists(arena, rows):
    assert rows(explorer.explore_models(arena)) == [("gpt",), ("phi",), ("yi",)]
    assert rows(explorer.explore_categories(arena)) == [("art",), ("sport",)]
    assert rows(explorer.explore_versions(arena), "family", "version") == [
        ("gpt", "4"), ("gpt", "5"), ("phi", "3"), ("phi", "4")]


def test_listing(arena):
    got = explorer.explore_list(arena, n=4).collect()
    assert [r.arena_id for r in got] == [0, 1, 2, 3] and {r.total for r in got} == {5}
    assert [r.preview for r in got] == ["x" * 130 + "…", "—", "—", "court"]
    assert [r.verdict for r in got] == ["a", "b", "equal", "none"]
    assert explorer.explore_list(arena.filter("arena_id = 4")).first().preview == "y" * 130
    assert explorer.explore_detail(arena, 4).first().verdict == "a"


def test_pair_turns(spark, rows):
    df = spark.sql("""SELECT 1 id,
      array(named_struct('role','user','content','u1'), named_struct('role','assistant','content','a1'),
            named_struct('role','user','content','u2')) conversation_a,
      array(named_struct('role','assistant','content','b1'), named_struct('role','system','content','s')) conversation_b
      UNION ALL SELECT 2, NULL, NULL UNION ALL SELECT 3, array(), array()""")
    assert rows(explorer.pair_turns(df, ["id"]), "id", "turn", "user", "answer") == [(1, 1, "u1", "b1")]
    assert rows(explorer.pair_turns(df, ["id"], "a"), "id", "turn", "user", "answer") == [(1, 1, "u1", "a1")]


def test_feedback(spark):
    flags = ["useful", "creative", "clear_formatting", "incorrect", "superficial", "instructions_not_followed"]
    columns = ", ".join(
        f"{'true' if (f, s) in {('useful', 'a'), ('superficial', 'a')} else 'CAST(NULL AS BOOLEAN)'} conv_{f}_{s}"
        for f in flags for s in "ab")
    df = spark.sql(f"SELECT 1 id, {columns}, ' bien\\n' conv_comments_a, CAST(NULL AS STRING) conv_comments_b")
    row = explorer.feedback_tags(df, ["id"]).first()
    assert (row.positive_a, row.negative_a, row.comment_a) == (["Utile"], ["Superficiel"], "bien")
    assert (row.positive_b, row.negative_b, row.comment_b) == ([], [], "")


def test_text_tables(spark, tmp_path):
    path = tmp_path / "art.csv"
    path.write_text("Auteur|Domaine|Periode_de_creation|Region|Nom_officiel_musee|extra\n"
                    "007|peinture||IDF|Orsay|x\n\"a|b\"|court\n", encoding="utf8")
    got = [tuple(r) for r in files.read_artworks(spark, str(path)).collect()]
    assert got == [("007", "peinture", None, "IDF", "Orsay"), ("a|b", "court", None, None, None)]
    assert {t for _, t in files.read_artworks(spark, str(path)).dtypes} == {"string"}


def test_venue_columns(spark, tmp_path):
    path = tmp_path / "lieux.csv"
    path.write_text("x;Nom;Type équipement ou lieu;Domaine;Région;Département;libelle_geographique\n"
                    "1;Louvre;Musée;d;IDF;75;Paris\n", encoding="utf8")
    out = files.read_venues(spark, str(path))
    assert out.columns == ["Nom", "Type_equipement", "Domaine", "Region", "Département", "Commune"]
    assert out.first().Type_equipement == "Musée"


def test_prices(spark, tmp_path):
    path = tmp_path / "prices.json"
    path.write_text(json.dumps({"data": [
        {"id": "a/x", "pricing": {"completion": "0.1", "prompt": "1"}}, {"id": "b"}, {"pricing": None}]}, indent=1))
    assert [tuple(r) for r in files.read_prices(spark, str(path)).collect()] == [
        (0, "a/x", "0.1"), (1, "b", None), (2, "", None)]


def test_missing_inputs(spark, tmp_path):
    assert files.read_or_empty(spark, str(tmp_path / "no.parquet"), schemas.BIAS_SCORES).count() == 0
    assert files.read_cleaned(spark, str(tmp_path)) is None
    for name in ("conv", "vot", "react"):
        files.write_parquet(spark.range(2), str(tmp_path / f"{name}.parquet"))
    assert [df.count() for df in files.read_cleaned(spark, str(tmp_path))] == [2, 2, 2]


def test_stored_tables_use_the_session_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.checkpoint_dir(spark) == folder
    kept = session.stored(spark.range(3), "three")
    assert kept.count() == 3 and all(folder in path and "three-" in path for path in kept.inputFiles())
    assert folder in spark.sparkContext._jsc.sc().getCheckpointDir().get()


def test_small_tables_are_spread(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = derived.spread_small(df, "doc_id")
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_prices_in_parts_of_bounded_size(spark, tmp_path):
    rows = [(3 * k + 1, f"m/{k}", None if k % 5 == 0 else str(k)) for k in range(100)]
    prices = spark.createDataFrame(rows[::-1], "position long, id string, completion string")
    files.write_prices(prices, f"{tmp_path}/prices", rows=20)
    stored = [p.read_text() for p in tmp_path.glob("prices/*/part-*")]
    assert len(stored) == 15 and max(text.count('"id"') for text in stored) <= 7
    got = sorted(map(tuple, files.read_prices(spark, f"{tmp_path}/prices").collect()))
    assert got == [(k, i, c) for k, (_, i, c) in enumerate(rows)]
    files.write_prices(prices.limit(0), f"{tmp_path}/none")
    assert files.read_prices(spark, f"{tmp_path}/none").count() == 0

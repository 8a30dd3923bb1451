from duelytics import registry, schemas
from duelytics.constants import ARENA_COLUMNS
from duelytics.operators import cleaning
from duelytics.plans import cleaning_job
from duelytics.sources import files


def duels(spark, data):
    return spark.createDataFrame(data, "id long, model_a_name string, model_b_name string, conv_turns int")


def test_junk_filter_drops_null_names(spark, rows):
    df = duels(spark, [(1, "gpt-4", "phi-4", 1), (2, None, "phi-4", 1), (3, "<b>", "phi-4", 1),
                       (4, "gpt-4", "javascript", 1), (5, "none", "phi-4", 1)])
    assert rows(cleaning.drop_junk_names(df), "id") == [(1,), (5,)]
    assert rows(cleaning.drop_bad_names(df), "id") == [(1,), (3,), (4,)]


def test_turns_and_families(spark, rows):
    df = duels(spark, [(1, "gpt-4", "phi-4", 1), (2, "gpt-4", "phi-4", 0), (3, "gpt-4", "phi-4", None),
                       (4, "o3-mini", "phi-4", 2)])
    assert rows(cleaning.normalize_models(df), "id") == [(1,)]
    assert rows(cleaning.normalize_models(df.drop("conv_turns")), "id") == [(1,), (2,), (3,)]


def test_visitor(spark, rows):
    df = spark.createDataFrame([("", "s1"), (None, "s2"), ("v", "s3")], "visitor_id string, session_hash string")
    assert rows(cleaning.fill_visitor(df), "visitor_id") == [("s1",), ("s2",), ("v",)]


def test_winner_keeps_empty_family(spark):
    df = spark.createDataFrame([("o3-mini",), (None,), ("Claude-4-5-sonnet",)], "chosen_model_name string")
    out = {r.chosen_model_name: (r.chosen_base_model, r.chosen_version)
           for r in cleaning.normalize_winner(df).collect()}
    assert out == {"o3-mini": ("", "o3-mini"), None: (None, None),
                   "Claude-4-5-sonnet": ("claude", "4-5-sonnet")}


def test_reaction_side(spark, rows):
    df = spark.createDataFrame(
        [("a",), ("b",), ("c",), (None,)], "model_pos string"
    ).selectExpr("model_pos", "'x' base_model_a", "'y' base_model_b", "'1' version_a", "'2' version_b")
    out = cleaning.reaction_side(df)
    assert rows(out, "model_pos", "model", "version") == [
        ("a", "x", "1"), ("b", "y", "2"), ("c", None, None), (None, None, None)]


def test_pruned_columns(spark):
    react = spark.sql("SELECT 1 id, 2 visitor_id, 3 comment, 4 model, 5 version, 6 liked, 7 wide, 8 msg_rank")
    assert cleaning.prune_reactions(react).columns == ["id", "model", "version", "liked"]
    votes = spark.sql("SELECT 1 id, 2 session_id, 3 conversation_a, 4 chosen_id, 5 base_model_id, 6 mode")
    assert cleaning.prune_votes(votes).columns == ["id", "chosen_id", "base_model_id", "mode"]
    conv = spark.sql("SELECT 1 conv_a_id, 2 session_hash, 3 mode, 4 visitor_id")
    assert cleaning.prune_conversations(conv).columns == ["mode", "visitor_id"]
    assert len(ARENA_COLUMNS) == 27
    assert cleaning.arena_project(votes).columns == ["conversation_a"]


def test_arena_id_is_consecutive_in_file_order(spark, tmp_path):
    path = str(tmp_path / "arena.parquet")
    spark.range(500).selectExpr("id AS k", "array('a long transcript') AS conversation_a").repartition(7).sortWithinPartitions(
        "k").write.parquet(path)
    out = cleaning.arena_row_id(spark.read.parquet(path))
    got = sorted(out.collect(), key=lambda r: r.arena_id)
    assert [r.arena_id for r in got] == list(range(500)) and {r.k for r in got} == set(range(500))
    assert sum(a.k > b.k for a, b in zip(got, got[1:])) <= 6
    moved = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in x or "Window" in x]
    assert not any("conversation_a" in x for x in moved)
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and "hashpartitioning(_own" not in physical


def test_both_ways_to_names_give_one_schema(spark, rows):
    df = spark.createDataFrame([(1, "gpt-4", "phi-4", 1, "phi-4"), (2, "o1", "phi-4", 1, None), (3, "Claude-3-opus", "yi-34b", 2, "yi-34b")],
                               "id long, model_a_name string, model_b_name string, conv_turns int, chosen_model_name string")
    names = cleaning.name_table(df, cleaning.VOTE_NAMES)
    for build in (cleaning.normalize_models, cleaning.normalize_winner):
        looked_up, computed = build(df, names), build(df)
        assert looked_up.columns == computed.columns
        assert rows(looked_up) == rows(computed)


def test_bias_project_keeps_french(spark, rows):
    df = spark.createDataFrame(
        [(1, ["fr", "en"]), (2, ["en"]), (3, None), (4, [])], "visitor_id int, languages array<string>")
    assert rows(cleaning.bias_project(df), "visitor_id") == [(1,)]


def test_job_writes_what_exists(spark, tmp_path):
    source, target = str(tmp_path / "raw"), str(tmp_path / "clean")
    assert cleaning_job.run(spark, source, target) == []
    empty = {f.name: None for f in schemas.VOTES}
    vote = {**empty, "id": 1, "model_a_name": "gpt-4", "model_b_name": "phi-4", "conv_turns": 2,
            "chosen_model_name": "phi-4", "both_equal": False}
    junk = {**vote, "id": 2, "model_a_name": "<b>bold-7b"}
    schema = schemas.struct(id=schemas.LONG, **{f.name: f.dataType for f in schemas.VOTES})
    spark.createDataFrame([vote, junk], schema).write.parquet(f"{source}/votes.parquet")
    assert cleaning_job.run(spark, source, target) == ["vot", "arena"]
    vot = spark.read.parquet(f"{target}/vot.parquet")
    arena = spark.read.parquet(f"{target}/arena.parquet")
    assert vot.count() == 2 and arena.count() == 1
    assert {"chosen_base_model", "chosen_version", "base_model_a"} <= set(vot.columns)
    assert set(ARENA_COLUMNS) <= set(arena.columns)
    assert files.read_arena(spark, f"{target}/arena.parquet").first().arena_id == 0
    assert files.read_arena(spark, f"{target}/none.parquet") is None


def test_reactions_normalize_each_name_once(spark, rows, monkeypatch):
    """The query looks names up; before, some sixty regular expressions ran on every reaction."""
    data = [(1, 1, "gpt-4o-mini", "claude-3-5-sonnet-v2", "a", 2), (1, 2, "gpt-4o-mini", "claude-3-5-sonnet-v2", "b", 2),
            (2, 1, None, "gpt-4o-mini", "b", 1), (3, 1, "gpt-4o-mini", "12", "a", 1), (4, 1, "gpt-4o-mini", "phi-4", None, 1),
            (5, 1, "phi-4", "phi-4", "a", 0), (1, 1, "gpt-4o-mini", "claude-3-5-sonnet-v2", "a", 2)]
    reactions = spark.createDataFrame(
        data, "id long, msg_rank long, model_a_name string, model_b_name string, model_pos string, conv_turns long")
    monkeypatch.setattr(registry.Tables, "raw", lambda self, name: {"reactions": reactions, "duel_names": reactions}[name])
    out = registry.queries()["reaction_side"](spark, "")
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    expected = reactions.transform(cleaning.normalize_models).transform(cleaning.reaction_side)
    assert rows(out) == rows(expected.select(*out.columns)) and out.count() >= 4

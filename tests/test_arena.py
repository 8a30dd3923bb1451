import pytest
from pyspark.sql import functions as F

from duelytics import registry
from duelytics.operators import cleaning, explorer
from duelytics.sources import arena, files
from tests.conftest import SF


@pytest.fixture(scope="module", params=["stored", "counted"])
def path(request, spark, tmp_path_factory):
    """The arena in some files, one of them empty, with and without its offsets."""
    folder = f"{tmp_path_factory.mktemp('arena')}/arena [x]{request.param}.parquet".replace("[x]", "")
    t = registry.Tables(spark, SF)
    cleaning.build_arena(t.duels, "duel_id", t.names).repartitionByRange(7, "duel_id").write.parquet(folder)
    if request.param == "stored":
        arena.write_offsets(spark, folder)
    return folder


def test_one_duel_from_one_file(spark, path):
    table = files.read_arena(spark, path)
    everything = {r.arena_id: r.duel_id for r in table.select("arena_id", "duel_id").collect()}
    assert sorted(everything) == list(range(len(everything)))
    for arena_id in [0, 1, len(everything) // 2, len(everything) - 1]:
        found = arena.read_duel(spark, path, arena_id)
        assert [(r.arena_id, r.duel_id) for r in found.select("arena_id", "duel_id").collect()] == [
            (arena_id, everything[arena_id])]
        assert len(found.inputFiles()) == 1
        assert sorted(found.columns) == sorted(table.columns)
    for arena_id in (-1, len(everything)):
        assert arena.read_duel(spark, path, arena_id).count() == 0


@pytest.mark.parametrize("options, n", [({}, 5), ({}, 10_000), ({"m1": "gpt"}, 20), ({"m1": "gpt", "turns": "4+"}, 3),
                                        ({"m1": "no such model"}, 5)])
def test_first_hits_as_by_numbering_everything(spark, path, rows, options, n):
    def keep(duels):
        return explorer.explore(duels, **options)

    expected = explorer.explore_list(keep(files.read_arena(spark, path)), n)
    found = arena.first_duels(spark, path, keep, n)
    assert rows(explorer.listed(found)) == rows(expected)
    if not options and n == 5:
        assert len(found.inputFiles()) == 1


def test_a_plain_reader(spark, path):
    assert files.read_duels(spark, path).count() == files.read_arena(spark, path).count()
    assert "arena_id" not in files.read_duels(spark, path).columns
    assert files.read_duels(spark, path + "-missing") is None


def test_an_empty_table(spark, tmp_path):
    t = registry.Tables(spark, SF)
    folder = str(tmp_path / "arena")
    cleaning.build_arena(t.duels, "duel_id", t.names).where(F.lit(False)).write.parquet(folder)
    arena.write_offsets(spark, folder)
    assert arena.read_duel(spark, folder, 0).count() == 0
    assert arena.first_duels(spark, folder, lambda d: d).count() == 0

"""Outputs that take their places together, and tables that go with their job."""

import os

import pytest
from pyspark.sql import functions as F

from duelytics.plans import cleaning_job
from duelytics.session import stored, temporary
from duelytics.sources import publish
from duelytics.sources.files import read_parquet, write_parquet


def values(spark, path):
    return sorted(r[0] for r in read_parquet(spark, path).collect())


def failing(spark):
    return spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))


def test_replaces(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    write_parquet(spark.range(3), path)
    write_parquet(spark.range(7, 9), path)
    assert values(spark, path) == [7, 8]
    assert os.listdir(tmp_path) == ["t.parquet"]


def test_failed_write_keeps_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    write_parquet(spark.range(3), path)
    with pytest.raises(Exception, match="lost"):
        write_parquet(failing(spark), path)
    assert values(spark, path) == [0, 1, 2]
    assert os.listdir(tmp_path) == ["t.parquet"]


def test_made_from_the_table_it_replaces(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    write_parquet(spark.range(3), path)
    write_parquet(read_parquet(spark, path).select((F.col("id") * 10).alias("id")), path)
    assert values(spark, path) == [0, 10, 20]


def test_all_or_none(spark, tmp_path):
    folder = str(tmp_path)
    with publish.publishing(spark, folder) as job:
        job.write(spark.range(1), "a")
        job.write(spark.range(1), "b")
    with pytest.raises(Exception, match="lost"):
        with publish.publishing(spark, folder) as job:
            job.write(spark.range(5), "a")
            job.write(failing(spark), "b")
    assert values(spark, f"{folder}/a") == values(spark, f"{folder}/b") == [0]
    assert sorted(os.listdir(folder)) == ["a", "b"]


@pytest.mark.parametrize("renames", [0, 1, 2, 3])
def test_recorded_job_is_finished_later(spark, tmp_path, monkeypatch, renames):
    """The job is lost after its record and some renames; the next one finishes it first."""
    folder, done = str(tmp_path), []
    for name in ("a", "b"):
        write_parquet(spark.range(1), f"{folder}/{name}")
    plain = publish.Folder.rename

    def lost(self, old, new):
        if not new.startswith(publish.RECORD):
            if len(done) == renames:
                raise KeyboardInterrupt
            done.append(new)
        plain(self, old, new)

    monkeypatch.setattr(publish.Folder, "rename", lost)
    with pytest.raises(KeyboardInterrupt):
        with publish.publishing(spark, folder) as job:
            job.write(spark.range(2), "a")
            job.write(spark.range(3), "b")
    monkeypatch.undo()
    publish.recover(spark, folder)
    assert values(spark, f"{folder}/a") == [0, 1] and values(spark, f"{folder}/b") == [0, 1, 2]
    assert sorted(os.listdir(folder)) == ["a", "b"]


def test_changed_files_are_not_published(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    monkeypatch.setattr(publish, "put_in_place", lambda *_: None)
    with publish.publishing(spark, folder) as job:
        path = job.write(spark.range(4, numPartitions=2), "a")
    monkeypatch.undo()
    os.remove(next(os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith("part-")))
    with pytest.raises(OSError, match="not the table"):
        publish.recover(spark, folder)


def test_temporary_tables_go(spark):
    with temporary(spark):
        kept = stored(spark.range(3))
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and kept.count() == 3
    assert not os.path.exists(path)
    outside = stored(spark.range(3))
    assert outside.count() == 3


def test_clean_job_on_missing_tables_writes_nothing(spark, tmp_path):
    assert cleaning_job.run(spark, f"{tmp_path}/raw", f"{tmp_path}/clean") == []
    assert not os.path.exists(f"{tmp_path}/clean")

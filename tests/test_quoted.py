import csv
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duelytics.sources import files, quoted


def one_task(spark, path, separator="|"):
    return spark.read.options(sep=separator, header=True, multiLine=True, quote='"', escape='"').csv(str(path))


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write(path, rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, delimiter="|", quoting=quoting, lineterminator=end).writerows(rows)


def random_rows(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "é", "\n", "\n\n", '"', "|", " ", "word", "x" * 50, ""]
    return [["one", "two words", "t.hree"]] + [
        ["".join(rng.choices(pieces, k=rng.randint(0, 9))) or "v" for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("seed, quoting, end", [(1, csv.QUOTE_MINIMAL, "\n"), (2, csv.QUOTE_ALL, "\n"), (3, csv.QUOTE_MINIMAL, "\r\n")])
def test_one_file_in_many_splits_as_in_one_task(spark, small_splits, tmp_path, rows, seed, quoting, end):
    expected = random_rows(seed, 600)
    write(tmp_path / "t.csv", expected, quoting, end)
    assert quoted.read_lines(spark, str(tmp_path / "t.csv")).rdd.getNumPartitions() > 10
    effects = quoted.split_effects(quoted.read_lines(spark, str(tmp_path)), "|")
    assert quoted.open_splits(effects).count() > 1  # some borders lie inside quotes
    got = quoted.read_quoted_table(spark, str(tmp_path), "|")
    assert got.columns == expected[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected[1:]))
    if end == "\n":
        names = [f"c{i}" for i in range(3)]
        assert rows(got.toDF(*names)) == rows(one_task(spark, tmp_path).toDF(*names))


def test_a_field_longer_than_many_splits(spark, small_splits, tmp_path):
    text = "line of text\n" * 2000
    write(tmp_path / "t.csv", [["a", "b", "c"], ["1", text, "3"], ["4", "5", "6"], ["7", text + '"', "|"]])
    got = {tuple(r) for r in quoted.read_quoted_table(spark, str(tmp_path), "|").collect()}
    assert got == {("1", text, "3"), ("4", "5", "6"), ("7", text + '"', "|")}


def test_damaged_lines_as_in_one_task(spark, small_splits, tmp_path, rows):
    lines = ["a|b|c"]
    for k in range(200):
        lines += [f'{k}|5" pipe|x', f'{k}|short', f'{k}|"quoted"tail|y', "", f'{k}|1|2|surplus', f'{k}||""', f'{k}|"two\nlines"|z']
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    assert rows(quoted.read_quoted_table(spark, str(tmp_path), "|")) == rows(one_task(spark, tmp_path))


def test_each_file_of_a_folder_has_its_header(spark, small_splits, tmp_path):
    expected = []
    for k in range(3):
        own = random_rows(10 + k, 50)
        write(tmp_path / f"part{k}.csv", own)
        expected += own[1:]
    (tmp_path / "empty.csv").write_text("")
    got = quoted.read_quoted_table(spark, str(tmp_path), "|")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected))


def test_bytes_that_are_no_text_are_tolerated(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'a|b\n1|"x\n\xff"\n2|y\n')
    got = sorted(r.a for r in quoted.read_quoted_table(spark, str(tmp_path), "|").collect())
    assert got == ["1", "2"]


def test_the_catalogue_readers_use_it(spark, small_splits, tmp_path):
    table = spark.range(300).select(*[
        F.concat(F.lit(c), F.col("id").cast("string"), F.lit('\n"x"')).alias(c) for c in files.ARTWORK_COLUMNS])
    files.write_text_table(table.coalesce(1), str(tmp_path / "art"), "|")
    read = files.read_artworks(spark, str(tmp_path / "art"), multi_line=True)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, table.collect()))


def test_the_files_are_left_when_the_table_is_there(spark, small_splits, tmp_path, rows):
    """However often the rows are used, the files are cut into records once; columns are chosen by name."""
    expected = random_rows(4, 300)
    write(tmp_path / "t.csv", expected)
    got = quoted.read_quoted_table(spark, str(tmp_path / "t.csv"), "|", ["t.hree", "one"])
    assert not any(str(tmp_path) in path for path in got.inputFiles())
    assert got.columns == ["t.hree", "one"]
    assert sorted(map(tuple, got.collect())) == sorted((r[2], r[0]) for r in expected[1:])


@pytest.mark.parametrize("separator", ["|", ";", "||", "\t"])
def test_quotes_of_many_lines_at_once_as_of_each_alone(separator):
    rng = random.Random(separator)
    for _ in range(300):
        pieces = ["a", "é", '"', '"', '""', separator, separator[0], "\r", ""]
        lines = ["".join(rng.choices(pieces, k=rng.randint(0, 8))).encode() for _ in range(rng.randint(1, 12))]
        column = pa.array([b'x"', *lines, b'"']).slice(1, len(lines))
        for state, got in zip((False, True), quoted.open_behind(column, separator.encode(), False, True)):
            expected, inside = [], state
            for line in lines:
                expected.append(inside := quoted.open_after(line, inside, separator.encode()))
            assert got.tolist() == expected
    assert quoted.open_behind(pa.array([None, b"a", None], pa.binary()), b"|", True)[0].tolist() == [True] * 3

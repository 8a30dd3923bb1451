"""Delimited files with line breaks inside quotes, read in splits.

Whether a line break ends a record depends on whether a quote is open, and that on everything in front.
But a range of a file only turns "no quote open" and "a quote open" at its beginning into one of both at
its end. A first pass finds these two answers for every split, from the lines that hold a quote; putting them behind
one another in the order of a file gives the true state at the beginning of each. A second pass cuts every split
into records on its own, whose fields are stored once, as Parquet; only the pieces at its two ends are joined with
those of its neighbours. (No whole record moves, and however often the table is used, the files are scanned twice.)

A quote counts where it begins a field, and inside such a field unless it is doubled, as for Spark's own
reader, which reads a file with `multiLine` in one task. So of quotes that stand side by side an even number changes
nothing, and an odd number opens or closes at the beginning of a field and can only close elsewhere: a batch of
lines is looked at as bytes, without a step for each line.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from duelytics.session import stored

QUOTE = b'"'


def open_after(line: bytes, inside: bool, separator: bytes) -> bool:
    """Whether a quote is open at the end of a line that begins inside or outside of one."""
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] == QUOTE:
                inside, at = True, at + 1
                continue
        else:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == QUOTE:
                at += 2
                continue
            inside = False
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)


def changes(lines: pa.Array, separator: bytes) -> tuple[np.ndarray, np.ndarray]:
    """line, turns: what changes whether a quote is open, in order: the number of its line, and whether it opens or
    closes or can only close.  Null is a line without quotes."""
    if len(separator) > 1:  # which may overlap itself, so its places depend on what is in front
        found = []
        for i, line in enumerate(lines.to_pylist()):
            closed, opened = (line and open_after(line, x, separator) for x in (False, True))
            if line and (closed or not opened):
                found += [(i, False)] * (closed == opened) + [(i, True)] * closed
        return np.array([i for i, _ in found], np.int64), np.array([x for _, x in found], bool)
    _, borders, content = lines.buffers()
    borders = np.frombuffer(borders, np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8)[borders[0] : borders[-1]] if content else np.zeros(0, np.uint8)
    borders -= borders[0]
    at = np.flatnonzero(data == QUOTE[0])
    line = np.searchsorted(borders, at, "right") - 1
    leads = at == borders[line]
    runs = np.flatnonzero(leads | (np.diff(at, prepend=-2) > 1))
    runs = runs[np.diff(runs, append=len(at)) % 2 == 1]
    return line[runs], leads[runs] | (data[at[runs] - 1] == separator[0])


def open_behind(lines: pa.Array, separator: bytes, *states: bool) -> list[np.ndarray]:
    """Whether a quote is open behind each line, for each state in front of the first."""
    line, turns = changes(lines, separator)
    turned = np.concatenate([[0], np.cumsum(turns)])
    closed = np.maximum.accumulate(np.concatenate([[0], np.where(turns, 0, np.arange(1, len(turns) + 1))]))
    last = np.searchsorted(line, np.arange(len(lines)), "right")
    behind = turned - turned[closed]
    return [((behind + (closed == 0) * state) % 2 == 1)[last] for state in states]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), start (of the split), line: in the order of each split, which one task reads."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array, bool]]:
    """(file, start, lines, is_last): the lines of a split, a batch at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column("file").to_numpy(), batch.column("start").to_numpy()])
        borders = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        for low, high in zip([0, *borders.tolist()], [*borders.tolist(), batch.num_rows]):
            file, start = keys[:, low].tolist()
            if held is not None:
                yield *held, held[:2] != (file, start)
            held = file, start, batch.column("line").slice(low, high - low)
    if held is not None:
        yield *held, True


def split_effects(lines: DataFrame, separator: str) -> DataFrame:
    """file, start, after_closed, after_open: the state behind a split for either state in front."""
    sep = separator.encode()

    def work(batches):
        states = False, True
        for file, start, own, last in _by_split(batches):
            closed, opened = (bool(x[-1]) for x in open_behind(own, sep, False, True))
            states = tuple(opened if state else closed for state in states)
            if last:
                yield pa.RecordBatch.from_pydict(
                    {"file": [file], "start": [start], "after_closed": [states[0]], "after_open": [states[1]]}
                )
                states = False, True

    quoted = lines.withColumn("line", F.expr("CASE WHEN contains(line, X'22') THEN line END"))
    return quoted.mapInArrow(work, "file long, start long, after_closed boolean, after_open boolean")


def open_splits(effects: DataFrame) -> DataFrame:
    """file, start of the splits that begin inside a quote; one row for each split meets by file."""

    def work(splits: pd.DataFrame) -> pd.DataFrame:
        splits = splits.sort_values("start")
        state, begins = False, []
        for closed, opened in zip(splits.after_closed, splits.after_open):
            begins.append(state)
            state = opened if state else closed
        return splits.loc[begins, ["file", "start"]]

    return effects.groupBy("file").applyInPandas(work, "file long, start long")


def cut_records(lines: DataFrame, separator: str) -> DataFrame:
    """file, start, first (of its file), part, record: every record as one string.  `part` is 0 for a whole record, 1
    for one that goes on from the split before, 2 for one that goes on in the split behind.

    The splits that begin inside a quote, at most one for each 128 MB or so, travel with the tasks.
    """
    sep = separator.encode()
    begins: dict[int, set[int]] = {}
    for row in open_splits(split_effects(lines, separator)).toLocalIterator():
        begins.setdefault(row["file"], set()).add(row["start"])

    def work(batches):
        key, inside, held, number, head = None, False, [], 0, False

        def handed_on(records: pa.Array, part: int) -> pa.RecordBatch:
            n = len(records)
            first = np.zeros(n, bool)
            first[0] = key[1] == 0 and number == 0
            parts = np.zeros(n, np.int32)
            parts[0] = part
            return pa.RecordBatch.from_pydict({
                "file": np.full(n, key[0]), "start": np.full(n, key[1]), "first": first, "part": parts, "record": records})

        def joined(own: pa.Array, borders: np.ndarray) -> pa.Array:
            lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), own.slice(0, int(borders[-1])))
            return pc.binary_join(lists, b"\n")

        for file, start, own, last in _by_split(batches):
            if key != (file, start):
                key, held, number = (file, start), [], 0
                inside = head = start in begins.get(file, ())
            ended = pc.ends_with(own, b"\r")
            if pc.any(ended).as_py():
                own = pc.if_else(ended, pc.binary_slice(own, 0, -1), own)
            opened, = open_behind(own, sep, inside)
            inside = bool(opened[-1])
            borders = np.concatenate([[0], np.flatnonzero(~opened) + 1])
            if len(borders) > 1:
                records = joined(own, borders)
                if held:
                    begun = pa.array([b"\n".join([*held, records[0].as_py()])], pa.binary())
                    records = pa.concat_arrays([begun, records.slice(1)])
                yield handed_on(records, 1 if head else 0)
                held, head, number = [], False, number + len(records)
            if borders[-1] < len(own):
                rest = own.slice(int(borders[-1]))
                held.append(joined(rest, np.array([0, len(rest)]))[0].as_py())
            if last and held:  # goes on in the next split; with `head` it came from the one before, too
                yield handed_on(pa.array([b"\n".join(held)], pa.binary()), 1 if head else 2)
                held = []

    return lines.mapInArrow(work, "file long, start long, first boolean, part int, record binary").withColumn(
        "record", F.col("record").cast("string"))


def join_pieces(pieces: DataFrame) -> DataFrame:
    """first (of its file), record: the records that go over the borders of splits."""
    order = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("chain", F.sum((F.col("part") == 2).cast("int")).over(order)).groupBy("file", "chain").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "record"))),
                                 lambda x: x["record"]), "\n").alias("record"),
    )


def read_quoted_table(
    spark: SparkSession, path: str, separator: str, columns: Sequence[str] | None = None, **options
) -> DataFrame:
    """A delimited file or folder whose files begin with a header; every column, or some of them, as string.

    The names are those of one of the files. Empty lines are no records, a short record ends in nulls,
    surplus fields are left out, a quote that is never closed takes the rest of its file.  The rows are stored.
    """
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", **options}
    header = spark.read.options(header=True, inferSchema=False, multiLine=True, **options).csv(path).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in header)
    columns = list(columns or header)
    places = [f"c{i}" for i in range(len(columns))]  # whatever the names, they can be stored
    fields = [F.col("r")[name].alias(place) for name, place in zip(columns, places)]
    is_row = F.expr("NOT first AND record <> ''")
    cut = cut_records(read_lines(spark, path), separator).withColumn("whole", is_row & (F.col("part") == 0))
    parsed = cut.withColumn("r", F.when(F.col("whole"), F.from_csv("record", schema, options)))
    kept = stored(parsed.where("whole OR part > 0").select(
        "file", "start", "first", "part", F.when(F.col("part") > 0, F.col("record")).alias("record"), "whole", *fields
    ), "records")
    pieces = join_pieces(kept.where("part > 0").select("file", "start", "first", "part", "record"))
    over = stored(pieces.where(is_row).select(F.from_csv("record", schema, options).alias("r")).select(*fields), "records")
    return kept.where("whole").select(*places).unionByName(over).toDF(*columns)

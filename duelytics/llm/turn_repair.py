"""Repair of the turn structure of conversations by an integer-minimum path.

A repaired conversation is empty, or an optional system turn before pairs of user and assistant. Rows may be
kept, given another role, deleted, and empty turns inserted. The path through (row, state of the pattern)
has whole numbers as weights: the high digits hold the cost, and each row owns one low digit for what
is done at it, the first row the highest one. The digits 1 to 6 stand for D, ID, IK, IR, K, R in this (ASCII)
order, 0 and 1 for nothing and I at the end. As none of the six is the beginning of another, and the end
is padded with zero, the smaller number is the cheaper repair, or of equally cheap ones the one whose
letters come first: minimum and sum of plain integers decide everything. (Two insertions in a row are
never in a cheapest repair: without them it stays valid, or deleting a lone system turn is cheaper.)

Rows are range-partitioned by conversation and turn, so a long conversation is spread over tasks. Each
piece of at most `PIECE` rows becomes a 4 x 4 table of the least numbers from state to state; the
tables of a conversation are multiplied (in minimum and sum) in order. What meets in one task are some
six bytes a row of one conversation, and its audit, which is one cell. The repaired text
of a conversation streams through one task in order, as its digest asks for.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from duelytics.llm.store import stored

WHITE = " \t\n\x0b\x0c\r"
PIECE = 1024
RETURNED = 1000  # repaired rows in a batch
EMPTY = hashlib.sha256(b"").hexdigest()
RANGE = ["conv_id", "turn", "role", "text"]

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = [USER, USER, ASSISTANT, USER]  # the state after the one turn that may be written here
LEGAL = {"su", "ua", "au"}
EDITS = ["", "D", "ID", "IK", "IR", "K", "R"]
ROLE_COST = INSERT_COST = CUT_COST = 3
DELETE_COST = 4
KEPT, BLANK, DUPLICATE, TRUNCATED = range(4)
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of conversation and turn chooses."""

    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        named("role").alias("role"), named("text").alias("text"),
        (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("fate"))
    fate = F.col("fate")
    return rows.where(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def in_order(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """The rows with their piece and place in it; `again`: equal to the row before in every column."""

    def work(batches):
        base = TaskContext.get().partitionId() << 32
        piece, at, before = base, -1, None
        for batch in batches:
            pieces, places, again = [], [], []
            for row in zip(*(batch.column(c).to_pylist() for c in RANGE)):
                if before is None or row[0] != before[0] or at + 1 == most:
                    piece, at = piece + 1, -1
                at += 1
                pieces.append(piece)
                places.append(at)
                again.append(row == before)
                before = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pieces, pa.int64()), pa.array(places, pa.int32()), pa.array(again, pa.bool_())],
                names=[*batch.schema.names, "piece", "at", "again"])

    return rows.select(*RANGE).repartitionByRange(*RANGE).sortWithinPartitions(*RANGE).mapInArrow(
        work, "conv_id long, turn long, role string, text string, piece long, at int, again boolean")


def faults(ordered: DataFrame) -> DataFrame:
    """conv_id, piece, at, turn, initial, fault: the first fault of each row counts."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    narrow = ordered.select(
        "conv_id", "piece", "at", "turn", "role", "again", F.unhex(F.sha2("text", 256)).alias("digest"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = narrow.groupBy(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest")]).agg(
        F.min(F.struct("turn")).alias("first"))
    known = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role"))
                        & (F.col("digest") == F.col("f_digest")))
    earlier = F.col("again") | (F.struct("turn") > F.col("first"))
    return known.select("conv_id", "piece", "at", "turn", F.substring("role", 1, 1).alias("initial"), F.when(
        F.col("blank"), BLANK).when(earlier, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(KEPT).alias("fault"))


def edges(initial: str, fault: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, cost, digit) of all that can be done at a row."""
    for state in STATES:
        for inserted in (False, True):
            here, cost = (NEXT[state], INSERT_COST) if inserted else (state, 0)
            yield state, here, cost + DELETE_COST, 2 if inserted else 1
            if fault in (BLANK, DUPLICATE):
                continue
            cost += CUT_COST if fault == TRUNCATED else 0
            if (here, initial) in STEPS:
                yield state, STEPS[here, initial], cost, 3 if inserted else 5
            yield state, NEXT[here], cost + ROLE_COST, 4 if inserted else 6


def least(rows: list[tuple[str, int]]) -> list[list[int | None]]:
    """The least number of a path over `rows` (initial, fault) from each state to each."""
    n = len(rows)
    table = []
    options = {row: list(edges(*row)) for row in set(rows)}
    for start in STATES:
        best: list[int | None] = [None] * 4
        best[start] = 0
        for i, row in enumerate(rows):
            then: list[int | None] = [None] * 4
            for state, to, cost, digit in options[row]:
                if best[state] is not None:
                    number = best[state] + (cost << 3 * n) + (digit << 3 * (n - 1 - i))
                    if then[to] is None or number < then[to]:
                        then[to] = number
            best = then
        table.append(best)
    return table


def joined(left: list[list[int | None]], m: int, right: list[list[int | None]], n: int) -> list[list[int | None]]:
    """The table of m rows and n rows behind them."""

    def widened(table, own, behind):
        low = (1 << 3 * own) - 1
        return [[x if x is None else (x >> 3 * own << 3 * (m + n)) + ((x & low) << 3 * behind) for x in line] for line in table]

    left, right = widened(left, m, n), widened(right, n, 0)
    return [[min((left[i][k] + right[k][j] for k in STATES if left[i][k] is not None and right[k][j] is not None),
                 default=None) for j in STATES] for i in STATES]


def whole_path(tables: list[tuple[list[list[int | None]], int]]) -> tuple[int, str]:
    """Cost and digits of the best repair; the digits hold one for the end."""
    while len(tables) > 1:
        tables = [(joined(*a, *b[0]), a[1] + b[0][1]) if b else a
                  for a, *b in (tables[k:k + 2] for k in range(0, len(tables), 2))]
    best, n = tables[0]
    ends = [(x << 3) + (cost << 3 * (n + 1)) + digit for x, cost, digit in (
        (best[NOTHING][NOTHING], 0, 0), (best[NOTHING][ASSISTANT], 0, 0), (best[NOTHING][USER], INSERT_COST, 1))
        if x is not None]
    number = min(ends)
    return number >> 3 * (n + 1), f"{number & (1 << 3 * (n + 1)) - 1:0{n + 1}o}"


def _grouped(batches, key: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows that agree in a column, over the batches of a task."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return itertools.groupby(rows, lambda row: row[key])


def pieces(found: DataFrame) -> DataFrame:
    """One row for each piece: its rows, the table of least numbers, and counts for the report."""

    def work(batches):
        for batch in batches:
            out = []
            for conv, piece, rows in zip(*(c.to_pylist() for c in batch.columns)):
                turns = [r["turn"] for r in rows if r["turn"] is not None]
                initials, own = [r["initial"] for r in rows], [r["fault"] for r in rows]
                table = least(list(zip(initials, own)))
                out.append((
                    conv, piece, len(rows),
                    [None if x is None else x.to_bytes((x.bit_length() + 7) // 8) for line in table for x in line],
                    turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
                    initials[0], initials[-1], own.count(BLANK), own.count(DUPLICATE), own.count(TRUNCATED),
                    sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64(),
                     pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = ("conv_id long, piece long, n long, least array<binary>, low long, high long, turns long, first string,"
              " last string, blank long, duplicate long, truncated long, illegal long")
    names = [part.split()[0] for part in schema.split(",")]
    rows = F.array_sort(F.collect_list(F.struct("at", "turn", "initial", "fault")))
    return found.groupBy("conv_id", "piece").agg(rows.alias("rows")).mapInArrow(work, schema)


def decisions(parts: DataFrame) -> DataFrame:
    """Rows with a piece: its digits (the last piece also the end's) and how many turns stand before it. Rows
    without: the report of a conversation, and whether it begins with a system turn."""

    def work(batches):
        for conv, group in _grouped(batches, 0):
            group = list(group)
            tables = []
            for row in group:
                flat = [None if x is None else int.from_bytes(x) for x in row[3]]
                tables.append(([flat[4 * i:4 * i + 4] for i in STATES], row[2]))
            cost, digits = whole_path(tables)
            letters = "".join(EDITS[int(d)] for d in digits[:-1]) + ("I" if digits[-1] == "1" else "")
            system = sum(c != "D" for c in letters) % 2 == 1
            lows, highs = ([r[k] for r in group if r[k] is not None] for k in (4, 5))
            turns = sum(r[6] for r in group) - sum(a[5] is not None and a[5] == b[4] for a, b in zip(group, group[1:]))
            illegal = sum(r[12] for r in group) + sum(a[8] + b[7] not in LEGAL for a, b in zip(group, group[1:]))
            out = [(conv, None, None, system, highs[-1] - lows[0] + 1 - turns if lows else 0,
                    *(sum(r[k] for r in group) for k in (9, 10, 11)), illegal, cost, letters)]
            low = written = 0
            for row in group:
                own = digits[low:low + row[2]]
                low += row[2]
                # The digits of the last piece go on with the end's.
                out.append((conv, row[1], written, system, None, None, None, None, None, None,
                            own + (digits[-1] if row is group[-1] else "")))
                written += sum(len(EDITS[int(d)].replace("D", "")) for d in own)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 6 + [pa.string()]
    schema = ("conv_id long, piece long, written long, system boolean, gaps long, blank long, duplicate long,"
              " truncated long, illegal long, cost long, audit string")
    names = [part.split()[0] for part in schema.split(",")]
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(work, schema)


def repaired_rows(ordered: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id, turn, edit (K, R or I), role, text of the repaired conversations. Rows of a conversation are
    in one partition and in order; its text is read as a stream."""

    def work(batches):
        def turns():
            for (conv, piece), group in itertools.groupby(
                    (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))),
                    lambda row: row[:2]):
                _, _, _, _, _, digits, place, system = next(group)  # the decision stands before the rows

                def role(place):
                    return "user" if (place + system) % 2 == 0 else "assistant"

                left = iter(digits)
                for _, _, _, turn, own, text, _, _ in group:
                    edits = EDITS[int(next(left))]
                    if edits[0] == "I":
                        yield conv, None, "I", role(place), ""
                        place += 1
                    if edits[-1] != "D":
                        yield conv, turn, edits[-1], own if edits[-1] == "K" else role(place), text
                        place += 1
                if next(left, "0") == "1":
                    yield conv, None, "I", role(place), ""

        rows = turns()
        while held := list(itertools.islice(rows, RETURNED)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)],
                                             names=["conv_id", "turn", "edit", "role", "text"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    plan = decided.where("piece IS NOT NULL").select(
        "conv_id", "piece", F.lit(-1).alias("at"), F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), "written",
        F.col("system").cast("int").alias("system"))
    rows = ordered.select("conv_id", "piece", "at", "turn", "role", "text", F.lit(None).cast("long").alias("written"),
                          F.lit(None).cast("int").alias("system"))
    return plan.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "piece", "at").mapInArrow(
        work, "conv_id long, turn long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the `role:text` lines of each repaired conversation, from rows as
    `repaired_rows` hands them on."""

    def work(batches):
        for conv, rows in _grouped(batches, 0):
            digest = hashlib.sha256()
            for k, row in enumerate(rows):
                digest.update(f"{chr(10) if k else ''}{row[1]}:{row[2]}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "role", "text").mapInArrow(work, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (conv_id, turn, edit, role, text) and the report (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit) of the conversations that have a row.

    Rows stand in the order of turn (nulls first), role, text, so equal rows are neighbours. A null role or
    text counts as one space; rows without a conv_id are one conversation. Equal rows are duplicates of
    the first one. A null turn leaves no gap. Roles other than the three can only be changed or deleted, an
    empty role has no initial. Other columns are not looked at; an empty table gives two empty ones.
    """
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    ordered = stored(in_order(named, piece), "turns")
    decided = stored(decisions(stored(pieces(faults(ordered)), "pieces")), "decisions")
    report = decided.where("piece IS NULL").select("conv_id", *REPORT)
    return repaired_rows(ordered, decided), report


def audit(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for every conv_id of the table: the report of its rows after the damage, and the digest of
    the repaired ones. A conversation that lost all its rows has zeros, no audit and the digest of nothing."""
    repaired, report = repair(damaged(conversations), piece)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids
    for part in (report, digests(repaired)):
        part = part.withColumnRenamed("conv_id", "k")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("k")), "left").drop("k")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT[:-1]],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))

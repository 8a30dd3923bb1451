import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from duelytics.llm import turn_repair

WHITE = " \t\n\x0b\x0c\r"
ALLOWED = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        role = "user" if fate == 4 else role
        yield from [(conv, turn, role, text)] * (2 if fate == 3 else 1)


def first_faults(rows):
    seen = set()
    for _, role, text in rows:
        if not text.strip(WHITE):
            yield "blank"
        elif (role, text) in seen:
            yield "duplicate"
        else:
            yield "" if text.rstrip(WHITE)[-1] in ".!?" else "truncated"
        seen.add((role, text))


def cheapest(rows, faults):
    """Every way to repair, cheapest and then first letters first, any number of insertions."""
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, letters, i, last, out = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(rows) and last in ("", "a"):
            best = min(best or (cost, letters, out), (cost, letters, out))
            continue
        for role in ("user", "assistant"):
            if (last, role[0]) in ALLOWED and cost + 3 <= 4 * len(rows):
                heapq.heappush(heap, (cost + 3, letters + "I", i, role[0], out + ((role, ""),)))
        if i == len(rows):
            continue
        _, own, text = rows[i]
        heapq.heappush(heap, (cost + 4, letters + "D", i + 1, last, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        cost += 3 * (faults[i] == "truncated")
        if (last, own[:1]) in ALLOWED:
            heapq.heappush(heap, (cost, letters + "K", i + 1, own[:1], out + ((own, text),)))
        for role in ("user", "assistant"):
            if (last, role[0]) in ALLOWED:
                heapq.heappush(heap, (cost + 3, letters + "R", i + 1, role[0], out + ((role, text),)))
    return best


def expected(rows):
    by = defaultdict(list)
    for conv, *_ in rows:
        by[conv]
    for conv, *row in damage(rows):
        by[conv].append(tuple(row))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in own if t is not None]
        faults = list(first_faults(own))
        cost, letters, out = cheapest(own, faults)
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
               *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
               sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, letters,
               hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


COLUMNS = ["conv_id", *turn_repair.REPORT, "repaired_sha256"]


def found(df, **options):
    out = turn_repair.audit(df, **options)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


def odd_rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3, 4, None, -5]), rng.choice([None, *range(8)]),
             rng.choice(["user", "assistant"] * 3 + ["system", "", None, "tool", "ürgh"]),
             rng.choice(["a.", "b", "", None, "c!", "d? \n", "e\nf.", " \t", "g.\x0b", "Äh"])) for _ in range(n)]


@pytest.mark.parametrize("seed, piece", [(1, 1024), (2, 2), (3, 3), (4, 1)])
def test_as_by_trying_everything(spark, seed, piece):
    rows = odd_rows(seed, 40)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS piece", "1 AS at", "2 AS cost", "'y' AS written")
    assert found(df.repartition(5), piece=piece) == sorted(expected(rows), key=repr)


def test_a_long_conversation_is_cut_into_pieces(spark):
    rng = random.Random(7)
    rows = [(9, t, rng.choice(["user", "assistant", "assistant"]), f"{rng.choice('abc')}{t}{rng.choice(['.', ''])}")
            for t in range(3000)] + [(1, 0, "system", "x."), (1, 1, "user", "y.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df.repartition(6), piece=100) == found(df.repartition(1), piece=100_000)


def test_equal_rows_are_duplicates_of_the_first(spark):
    rows = [(3, 1, "user", "a.")] * 4 + [(3, 2, "assistant", "b.")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == list(expected(rows))
    many = found(spark.createDataFrame(rows * 500, SCHEMA))[0]
    n = len(list(damage(rows * 500)))
    assert many[COLUMNS.index("duplicate")] >= n - 2 and many[COLUMNS.index("audit")].count("D") >= n - 2


def test_joined_tables_are_the_tables_of_the_whole(spark):
    rng = random.Random(5)
    for _ in range(100):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randint(2, 9))]
        m = rng.randrange(1, len(rows))
        left, right = rows[:m], rows[m:]
        assert turn_repair.joined(turn_repair.least(left), m, turn_repair.least(right), len(right)) == turn_repair.least(rows)


def test_repaired_rows_have_the_pattern(spark):
    repaired, report = turn_repair.repair(spark.createDataFrame(odd_rows(11, 60), SCHEMA))
    by = defaultdict(list)
    for row in repaired.collect():
        by[row.conv_id].append(row)
    for row in report.collect():
        own = by[row.conv_id]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert "".join(r.edit for r in own) == row.audit.replace("D", "")


def test_nothing_to_repair(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    lost = next((c, t) for c in range(9) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*lost, "user", "a.")], SCHEMA)
    assert found(df) == [(lost[0], 0, 0, 0, 0, 0, 0, "", turn_repair.EMPTY)]

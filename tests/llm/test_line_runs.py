import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duelytics.llm import line_runs
from tests.llm.helpers import documents

WHITE = " \t\n\x0b\x0c\r"


def expected(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -1 if doc_id is None else doc_id
        kept = [x for x in lines
                if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    pool = [f"a shared line with number {i} and ÄÉ" for i in range(30)] + ["short", "", "   ", "x" * 19, "y" * 20]
    out = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"a line of its own {i} {k} ......"
                         for k in range(rng.randint(1, 9)))) for i in range(120)]
    hot = "The Very Frequent Line Of All\t"
    out += [(200 + i, f"{hot}\n  {hot.upper()}\nend {i}") for i in range(60)]
    return out + [(300, None), (301, ""), (302, "\n\n"), (None, hot), (303, "y" * 100_000 + "\n" + hot), (5, out[5][1]),
                  (304, hot.upper().replace("É", "é")), (305, hot)]


def test_against_brute_force(spark, rows):
    docs = documents(spark, rows, clashing=True)
    assert sorted(map(tuple, line_runs.dedup(docs).collect()), key=repr) == expected(rows)
    assert line_runs.dedup(documents(spark, [])).count() == 0


def test_number_of_batches_does_not_matter(spark, rows):
    docs = documents(spark, rows)
    assert sorted(map(tuple, line_runs.dedup(docs, batches=1).collect()), key=repr) == expected(rows)
    assert sorted(map(tuple, line_runs.dedup(docs, batches=7, min_docs=5).collect()), key=repr) == expected(
        rows, min_docs=5)


def test_runs_hold_every_line_once_and_are_compacted(spark):
    index = line_runs.LineRuns(spark, fan=2)
    for start in range(5):
        index.add(spark.range(start * 10, start * 10 + 20).selectExpr("id AS h1", "-id AS h2", f"{start} AS doc_id"))
    held = [r.h1 for run in index.runs() for r in run.collect()]
    assert sorted(held) == list(range(60))
    assert sum(map(len, index.levels.values())) <= 3
    counts = {r.h1: (r.n, r.top) for r in index.counts().collect()}
    assert counts[0] == (1, 0) and counts[15] == (2, 1) and counts[59] == (1, 4)
    plan = index.runs()[0].join(index.runs()[-1].select("h1", "h2"), ["h1", "h2"], "left_anti").hint(
        "merge")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    index.drop()


def test_texts_without_shared_lines(spark, rows):
    docs = documents(spark, rows, clashing=True)
    got = line_runs.without_shared_lines(docs)
    assert got.columns == docs.columns
    digests = sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=repr)
    assert digests == sorted(((r[0], r[3]) for r in expected(rows)), key=repr)
    assert got.where(F.col("doc_id") == 300).head().text is None

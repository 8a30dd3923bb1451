import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duelytics.llm import divergence
from tests.llm.helpers import words


def expected(rows, min_docs, shown):
    """lang, source, part, item, value, rank with plain loops."""
    groups, docs, counts = defaultdict(set), Counter(), Counter()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups[lang].add(source)
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        docs.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
    for lang, sources in groups.items():
        kept = [t for (own, t), n in docs.items() if own == lang and n >= min_docs]

        def shares(names):
            n = {t: sum(counts[lang, s, t] for s in names) for t in kept}
            total = sum(n.values())
            return {t: 1 + 1_000_000_000 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(sources), {s: shares([s]) for s in sources}
        for s in sources:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            near = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t])
            for part, items in (("pair", far), ("term", near[:shown])):
                yield from ((lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items))


def rows_of(rng, n):
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, "", "fr"]), rng.choice(["a", "b", "ä", "Z", None, "", "hot", "hot", "hot"])
        vocabulary = 12 if source == "hot" else 40
        text = " ".join(w.translate(str.maketrans("0123456789", "ABcdefÄhij")) for w in words(rng, rng.randint(0, 30), vocabulary))
        out.append((lang, source, rng.choice([text, text, text, None, "", "12 34"])))
    return out + [("it", "only", None), ("it", "other", "one"), ("lone", "x", "y y y")] + out[:3]


SCHEMA = "lang string, source string, text string"


@pytest.mark.parametrize("options", [{}, {"terms": 4, "sources": 2}, {"terms": 1, "sources": 1}])
def test_as_by_plain_loops(spark, options):
    rows = rows_of(random.Random(1), 400)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS doc_id", "2 AS n", "'x' AS term", "'y' AS piece", "3 AS number", "'z' AS part")
    found = divergence.audit(df.repartition(4), min_docs=5, shown=3, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == sorted(expected(rows, 5, 3))


def test_many_levels(spark):
    rng = random.Random(2)
    rows = [("en", f"s{k}", " ".join(w for w in "abcdefghijklmnop" for _ in range(rng.randint(0, 40))))
            for k in range(9) for _ in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = divergence.term_counts(df.repartition(1), held=20)
    assert counts.count() > 9 * 16  # handed on in parts
    assert {(r.source, r.term): r.n for r in counts.groupBy("source", "term").agg(F.sum("n").alias("n")).collect()} == {
        (s, w): n for s in {s for _, s, _ in rows} for w, n in Counter(
            " ".join(t for _, own, t in rows if own == s).split()).items()}
    assert sorted(map(tuple, divergence.audit(df, min_docs=3).collect())) == sorted(expected(rows, 3, 50))


def test_slices_of_columns(monkeypatch):
    rng = random.Random(6)
    rows = [(k // 4, k, 100 + k, f"t{t}", n, 1000 * n + k) for k in range(8) for t in range(50) for n in [rng.randint(0, 30)] if n]
    table = pa.table(dict(zip(["side", "number", "zero", "term", "n", "p"], map(list, zip(*rows)))))
    whole = divergence.joint_values(table)
    monkeypatch.setattr(divergence, "COLUMNS", 7)
    cut = divergence.joint_values(table)
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut))
    level = {(k, t): p for _, k, _, t, _, p in rows}
    for a, b, value in zip(*whole[:3]):
        assert value == sum(abs(level.get((a, f"t{t}"), 100 + a) - level.get((b, f"t{t}"), 100 + b)) for t in range(50)
                            if any((k, f"t{t}") in level for k in range(8)))


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(3_000_000_000_000_000, 7_000_000_000_000_001, 123_456)], "n long, total long, kept long")
    value = df.select(divergence.share(df.n, df.total, df.kept)).head()[0]
    assert value == 1 + 1_000_000_000 * (3_000_000_000_000_000 + 5) // (7_000_000_000_000_001 + 5 * 123_456)


def test_nothing_to_audit(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    found = divergence.audit(spark.createDataFrame([("en", "a", None), ("en", "b", "word")], SCHEMA)).collect()
    assert sorted(map(tuple, found)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]

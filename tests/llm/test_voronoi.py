import math
import random

import numpy as np
import pytest

from duelytics.llm import voronoi


def table(spark, rows, clashing=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "'x' AS key", "1 AS cell", "2 AS score", "3 AS rank", "'y' AS packed") if clashing else df


def expected(rows, every, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, set()).add(tuple(math.floor(64 * float(np.float32(x))) for x in v))
    out = []
    flat = [(i, v) for i, vs in whole.items() for v in vs]
    for i, v in flat:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in flat if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def rows_of(seed, n, width, spread):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("seed, spread", [(1, 0.01), (2, 0.5)])
def test_against_brute_force(spark, seed, spread):
    rows = rows_of(seed, 400, 12, spread)
    rows += [(500 + i, rows[7][1]) for i in range(120)]                   # one vector of many rows
    rows += [(700, None), (701, [None] * 12), (702, [float("nan")] * 12), (703, [float("inf")] * 12), (704, []),
             (720, [0.5, 0.25]), (None, rows[0][1]), (-20, [0.0] * 12), (5, rows[5][1])]
    got = voronoi.top_k(table(spark, rows, clashing=True), every=20, k=7).collect()
    assert sorted(map(tuple, got)) == expected(rows, 20, 7)


def test_few_and_no_rows(spark):
    assert voronoi.top_k(table(spark, [])).count() == 0
    assert voronoi.top_k(table(spark, [(0, [1.0])])).count() == 0
    got = voronoi.top_k(table(spark, [(0, [1.0]), (1, [1.0]), (2, [-1.0])]), k=20).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 4096), (0, 2, 2, -4096)]


def test_blocks_meet_in_one_ranking(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "DATA_ROWS", 50)
    monkeypatch.setattr(voronoi, "QUERY_ROWS", 3)
    rows = rows_of(3, 300, 8, 0.2)
    got = voronoi.top_k(table(spark, rows), every=10, k=5).collect()
    assert sorted(map(tuple, got)) == expected(rows, 10, 5)


def test_bounds_leave_out_what_cannot_matter():
    points = np.array([v for _, v in rows_of(4, 600, 12, 0.002)]) * 1000
    cells = voronoi.Cells(points[:16])
    import pandas as pd

    cell, distance = cells.nearest(points[::20])
    groups = pd.DataFrame({"cell": cell, "distance": distance, "norm": np.linalg.norm(points[::20], axis=1)}).groupby(
        "cell", as_index=False).agg(radius=("distance", "max"), norm=("norm", "max"))
    cell, distance = cells.nearest(points)
    cells.bounded(groups, pd.DataFrame({"cell": cell, "distance": distance}), 6)
    needed = cells.needed(cell, distance)
    assert needed[:, groups.cell].mean() < 0.6
    for q, i in zip(points[::20], cells.nearest(points[::20])[0]):
        top = np.argsort(-(points @ q))[:6]
        assert needed[top, i].all()


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**24, 3.0]), (1, [2.0**24, -1.0]), (2, [2.0**24, -2.0])]
    assert sorted(map(tuple, voronoi.top_k(table(spark, rows)).collect())) == expected(rows, 20, 20)

"""Exact top-k by inner product: a Voronoi join of queries with all vectors.

Vectors become integers floor(64 x). A bounded, seeded set of them are the pivots; every vector
belongs to the cell of its nearest pivot, every query to the group of its nearest pivot. With a cell's
pivot p and a point's distance d from it, the scores of a whole group (pivot c, radius R, largest
norm Q) lie in <c, p> +- (R |p| + Q d). The least distances of each cell bound each group's k-th score
from below; only points whose upper bound reaches it are sent to that group. Groups are solved in
blocks of bounded size, whose best candidates meet in one ranking.

Equal vectors are one: of a vector that many rows hold only the k + 1 smallest ids can matter, and
equal queries are solved once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from duelytics.llm.store import stored

SCALE, K, EVERY = 64, 20, 20
PIVOTS, SEED = 16, 11
QUERY_ROWS, DATA_ROWS, SLICE = 512, 16_384, 4096
_TYPES = [np.int16, np.int32, np.int64]


def pack(vector: np.ndarray) -> bytes:
    """The smallest integer type that holds the vector, and its values without trailing zeros, so
    that vectors which differ in zeros at the end only are equal."""
    used = np.flatnonzero(vector)
    vector = vector[: used[-1] + 1] if len(used) else vector[:0]
    top = max(abs(int(vector.max())), abs(int(vector.min()))) if len(vector) else 0
    kind = next(i for i, t in enumerate(_TYPES) if top <= np.iinfo(t).max)
    return bytes([kind]) + vector.astype(_TYPES[kind]).tobytes()


def unpack(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width), np.int64)
    for row, data in zip(out, packed):
        values = np.frombuffer(data, _TYPES[data[0]], offset=1)
        row[: len(values)] = values
    return out


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, packed, width, top: floor(scale * x) of every component; vectors that are null or hold
    a null or non-finite component, and rows without an id, are left out."""

    def work(batches):
        for batch in batches:
            ids, packed, widths, tops = [], [], [], []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                if vec_id is None or vector is None or any(x is None for x in vector):
                    continue
                values = np.floor(scale * np.array(vector, np.float64))
                if not np.isfinite(values).all():
                    continue
                values = np.clip(values, -(2.0**62), 2.0**62).astype(np.int64)
                ids.append(vec_id)
                packed.append(pack(values))
                widths.append(len(values))
                tops.append(float(np.abs(values).max()) if len(values) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(widths, pa.int32()),
                 pa.array(tops, pa.float64())], names=["vec_id", "packed", "width", "top"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        work, "vec_id long, packed binary, width int, top double")


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles while they are whole numbers there, else in 64-bit integers."""
    top = float(max(np.abs(queries).max(initial=0), 1)) * float(max(np.abs(data).max(initial=0), 1))
    if top * max(queries.shape[1], 1) < 2.0**53:
        return queries.astype(float) @ data.astype(float).T
    return queries @ data.T


class Cells:
    """Pivots and what is known of cells and groups; bounded by the number of pivots."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(float)
        self.norms = np.sqrt((self.pivots**2).sum(axis=1))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance of each point."""
        points = points.astype(float)
        squares = (points**2).sum(axis=1)[:, None] - 2 * points @ self.pivots.T + self.norms**2
        cell = squares.argmin(axis=1)
        return cell, np.sqrt(((points - self.pivots[cell]) ** 2).sum(axis=1))

    def bounded(self, groups: pd.DataFrame, summary: pd.DataFrame, k: int) -> None:
        """`groups`: cell, radius, norm of queries. `summary`: cell and its least distances."""
        n = len(self.pivots)
        self.radius, self.norm, self.active = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        self.radius[groups.cell], self.norm[groups.cell], self.active[groups.cell] = groups.radius, groups.norm, True
        self.between = self.pivots @ self.pivots.T
        self.slack = self.radius[:, None] * self.norms[None, :]
        cell, distance = summary.cell.to_numpy(), summary.distance.to_numpy()
        self.least = np.full(n, -np.inf)
        for i in np.flatnonzero(self.active):
            low = self.between[i, cell] - self.slack[i, cell] - self.norm[i] * distance
            if len(low) >= k:
                best = -np.partition(-low, k - 1)[k - 1]
                self.least[i] = best - 1e-9 * abs(best) - 1e-6

    def needed(self, cell: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Points x groups: whose best possible score reaches the group's k-th."""
        high = self.between[:, cell].T + self.slack[:, cell].T + distance[:, None] * self.norm[None, :]
        high += 1e-9 * np.abs(high) + 1e-6
        return (high >= self.least[None, :]) & self.active[None, :]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        held = score >= kth
        score, ids = score[held], ids[held]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` its `k` highest scores among
    the other rows, ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part. Missing components of
    shorter vectors count as zero, components beyond 2**62 as that, and scores beyond a long wrap.
    Rows that repeat a vec_id count once for each different vector. With fewer candidates than k
    there are fewer ranks; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stored(whole_numbers(vectors, scale).distinct(), "vectors")
    total = rows.agg(F.count("*"), F.max("width")).head()
    width = total[1] or 1
    keyed = rows.select("vec_id", "packed", F.md5("packed").alias("key"))
    queries = keyed.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = queries.groupBy("key").agg(F.first("packed").alias("packed"))
    place = Window.partitionBy("packed").orderBy("vec_id")
    data = stored(rows.select("vec_id", "packed").withColumn("n", F.row_number().over(place)).where(
        F.col("n") <= k + 1).drop("n"), "candidates")

    chosen = data.groupBy("packed").agg(F.min("vec_id").alias("id")).orderBy(
        F.xxhash64("packed", F.lit(SEED)), "id").limit(pivots).toPandas()
    cells = Cells(unpack(list(chosen["packed"]), width) if len(chosen) else np.zeros((1, width)))

    def group_summary(batches):
        for batch in batches:
            points = unpack(batch.column("packed").to_pylist(), width)
            cell, distance = cells.nearest(points)
            norm = np.sqrt((points.astype(float) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(norm)],
                names=["cell", "distance", "norm"])

    groups = asked.select("packed").mapInArrow(group_summary, "cell int, distance double, norm double").groupBy(
        "cell").agg(F.max("distance").alias("radius"), F.max("norm").alias("norm"), F.count("*").alias("n")).toPandas()

    def cell_summary(batches):
        """The least distances of each cell in one partition."""
        held = {}
        for batch in batches:
            cell, distance = cells.nearest(unpack(batch.column("packed").to_pylist(), width))
            for j in np.unique(cell):
                held[j] = np.sort(np.concatenate([held.get(j, np.zeros(0)), distance[cell == j]]))[: k + 1]
        for j, distance in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(distance), j, np.int32)), pa.array(distance)], names=["cell", "distance"])

    near = Window.partitionBy("cell").orderBy("distance")
    summary = data.select("packed").mapInArrow(cell_summary, "cell int, distance double").withColumn(
        "n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n").toPandas()  # pivots x (k + 1)
    cells.bounded(groups, summary, k + 1)

    parts = max(1, -(-total[0] // DATA_ROWS))
    asked_parts = np.ones(len(cells.pivots), np.int64)
    asked_parts[groups.cell] = -(-groups.n // QUERY_ROWS)

    def query_rows(batches):
        for batch in batches:
            packed = batch.column("packed").to_pylist()
            cell, _ = cells.nearest(unpack(packed, width))
            keys = batch.column("key").to_pylist()
            out = [(int(c), int(key[:8], 16) % int(asked_parts[c]), part, key, p)
                   for c, key, p in zip(cell, keys, packed) for part in range(parts)]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()])],
                names=["cell", "part", "block", "key", "packed"])

    def data_rows(batches):
        for batch in batches:
            packed = np.array(batch.column("packed").to_pylist() + [None], object)[:-1]
            ids = batch.column("vec_id").to_numpy()
            cell, distance = cells.nearest(unpack(list(packed), width))
            needed = cells.needed(cell, distance)
            for i in np.flatnonzero(needed.any(axis=0)):
                at = np.flatnonzero(needed[:, i])
                for part in range(asked_parts[i]):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, part)), pa.array(batch.column("block").to_numpy()[at]),
                         pa.array(ids[at]), pa.array(list(packed[at]), pa.binary())],
                        names=["cell", "part", "block", "vec_id", "packed"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, q = left.column("key").to_pylist(), unpack(left.column("packed").to_pylist(), width)
        ids = right.column("vec_id").to_numpy()
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(keys)
        for start in range(0, len(ids) if len(keys) else 0, SLICE):
            some = ids[start : start + SLICE]
            points = unpack(right.column("packed")[start : start + SLICE].to_pylist(), width)
            for n, row in enumerate(scores(q, points)):
                score, which = best(row, some, k + 1)
                held[n] = best(np.concatenate([held[n][0], score]) if len(held[n][0]) else score,
                               np.concatenate([held[n][1], which]) if len(held[n][1]) else which, k + 1)
        return pa.table({
            "key": pa.array([key for key, (s, _) in zip(keys, held) for _ in s], pa.string()),
            "vec_id": pa.array([int(i) for _, which in held for i in which], pa.int64()),
            "score": pa.array([int(x) for s, _ in held for x in s], pa.int64())})

    on = ["cell", "part", "block"]
    left = asked.mapInArrow(query_rows, "cell int, part long, block long, key string, packed binary").groupBy(*on)
    right = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts).cast("long"))).mapInArrow(
        data_rows, "cell int, part long, block long, vec_id long, packed binary").groupBy(*on)
    solved = left.cogroup(right).applyInArrow(solve, "key string, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    merged = solved.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(
        F.col("n") <= k + 1).drop("n")
    answered = queries.select(F.col("vec_id").alias("query_id"), "key").join(merged, "key").where(
        "vec_id <> query_id")
    ranked = answered.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

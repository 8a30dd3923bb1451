"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

The index of lines is a set of runs: tables of (128-bit line hash, documents, largest document),
each line in one run only, bucketed and sorted by hash. A new batch of documents is anti-joined
with the runs: lines that no run has make a run of their own at level 0, lines that are known are
counted beside them. When a level holds `FAN` runs they are merged into one of the next level, so
a line is rewritten a logarithmic number of times. As runs and batches are bucketed alike, the
joins are merges without a shuffle of the index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from duelytics.llm.store import new_folder, stored

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FAN = 4, 3
KEY = ["h1", "h2"]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, text_hash and the positions of a line in the text, one row for each distinct
    key of at least `min_chars` code points in a row of `docs`."""

    def work(batches):
        for batch in batches:
            ids, texts, high, low, places = [], [], [], [], []
            for doc_id, text_hash, text in zip(*(batch.column(c) for c in ("doc_id", "text_hash", "text"))):
                found: dict[str, list[int]] = {}
                for at, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(WHITE)) >= min_chars:
                        found.setdefault(key, []).append(at)
                lowered: dict[bytes, list[int]] = {}
                for key, at in found.items():
                    data = key.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
                    lowered.setdefault(data, []).extend(at)
                for data, at in lowered.items():
                    digest = hashlib.blake2b(data, digest_size=16).digest()
                    ids.append(doc_id.as_py())
                    texts.append(text_hash.as_py())
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low.append(int.from_bytes(digest[8:], "little", signed=True))
                    places.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(texts, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["h1", "h2", "doc_id", "text_hash", "places"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "xxhash64(text) AS text_hash", "text").mapInArrow(
        work, "h1 long, h2 long, doc_id long, text_hash long, places array<int>")


class LineRuns:
    """The index: runs by level, and the counts of lines that came again."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.again: list[str] = []
        self.folders: dict[str, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        """A table bucketed and sorted by hash, one file for each bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.folders[name] = new_folder(self.spark, "line-run")
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", self.folders[name]).saveAsTable(name))
        return name

    def _together(self, names: list[str]) -> DataFrame:
        """The rows of several tables in one plain scan."""
        schema = self.spark.table(names[0]).schema
        return self.spark.read.schema(schema).parquet(*[self.folders[name] for name in names])

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in sorted(self.levels) for name in self.levels[level]]

    def add(self, batch: DataFrame) -> None:
        """`batch`: h1, h2, doc_id. Lines unknown so far become a run, known ones are counted."""
        lines = batch.groupBy(*KEY).agg(
            F.count_distinct(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("n"), F.max("doc_id").alias("top"))
        own = self.spark.table(self._write(lines))
        runs, fresh = self.runs(), own
        for run in runs:
            fresh = fresh.join(run.select(*KEY), KEY, "left_anti")
        name = self._write(fresh)
        if runs:
            self.again.append(self._write(own.join(self.spark.table(name).select(*KEY), KEY, "left_anti")))
        self.levels[0].append(name)
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fan:
            self.levels[level + 1].append(self._write(self._together(self.levels.pop(level))))
            level += 1

    def counts(self) -> DataFrame:
        """h1, h2, n, top of all lines: documents that hold them and the largest of these."""
        names = [name for level in self.levels.values() for name in level]
        return self._together(names + self.again).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def drop(self) -> None:
        """Forget the tables; their files go with the session."""
        for names in [*self.levels.values(), self.again]:
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dropped_lines(docs: DataFrame, min_chars=MIN_CHARS, min_docs=MIN_DOCS, batches=BATCHES) -> DataFrame:
    """doc_id, text_hash and the positions of the lines it loses; texts that lose none have no row."""
    spark = docs.sparkSession
    lines = stored(line_hashes(docs, min_chars), "lines")
    # Batches by doc_id, the largest ids first.
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).head()[0] or []
    bounds = [None, *reversed(cuts), None]
    index = LineRuns(spark)
    for high, low in zip(bounds, bounds[1:]):
        part = lines
        if high is not None:
            part = part.where((F.col("doc_id") <= high) | F.col("doc_id").isNull() if low is None
                              else F.col("doc_id") <= high)
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        index.add(part.select(*KEY, "doc_id"))
    # Stored, so that the join stands on plain exchanges and a frequent line's rows can be split. The
    # table grows with the corpus, so it is merged at every size and never broadcast.
    shared = stored(index.counts().where(F.col("n") >= min_docs).select(
        F.col("h1").alias("a1"), F.col("h2").alias("a2"), "top"), "shared-lines").hint("merge")
    lost = lines.join(shared, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2"))).where(
        ~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = stored(lost.groupBy("doc_id", "text_hash").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")), "lost-lines")
    index.drop()
    return gone


def _with_lost(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows of `docs` with the positions they lose in `__places`."""
    lost = lost.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
                       F.col("places").alias("__places")).hint("merge")
    return docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
                     & (F.xxhash64("text") == F.col("__hash")), "left").drop("__id", "__hash")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of `docs`.

    A null or empty text is one empty line. Rows with the same doc_id count as one document, and
    the document with the largest id keeps all its lines, repeated ones too. Rows without an id are
    one document before all others. Lines below the length stay wherever they are. No rows give no
    rows; other columns are not looked at.
    """
    docs = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")

    def work(batches):
        for batch in batches:
            n, cut, digests = [], [], []
            for text, places in zip(batch.column("text"), batch.column("__places")):
                lines = (text.as_py() or "").split("\n")
                gone = set(places.as_py() or ())
                kept = [line for at, line in enumerate(lines) if at not in gone]
                n.append(len(lines))
                cut.append(len(lines) - len(kept))
                digests.append(hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()),
                 pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _with_lost(docs, dropped_lines(docs, **options)).mapInArrow(
        work, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_shared_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the remaining lines as text; other columns stay. A null text stays null; a text that loses
    all its lines is empty. Rows with the same doc_id count as one document, rows without one too; no rows
    give no rows. Only texts that lose a line are split, in the JVM."""
    lost = dropped_lines(docs.select("doc_id", "text"), **options)

    def rest(lines):  # bound once for all lines of a text
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__places"))
        return F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n")

    return _with_lost(docs, lost).withColumn("text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(
        F.get(F.transform(F.array(F.split("text", "\n", -1)), rest), F.lit(0)))).select(*docs.columns)

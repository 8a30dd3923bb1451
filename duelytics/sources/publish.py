"""Outputs of a job that take their places together, or not at all.

Every table is written to a folder of its own beside its place.  When all are written, one small record names
them with their number of files and bytes; from then on the job counts as done.  The tables
are then renamed into their places.  A job that fails before the record leaves the old tables as they are; one that
fails after it is finished by the next job on the folder, or by `recover`.  A reader that opens
a table between the two renames of its swap finds none.  On stores without renames a swap copies the table.  One job at a time may publish into
a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECORD = "_publish-"  # names with an underscore are hidden from readers of the folder


class Folder:
    """The few file operations needed, on any file system Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/") or "/"
        self.jvm = spark._jvm
        self.files = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.files.exists(self.at(name))

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.files.rename(self.at(old), self.at(new)):
            raise OSError(f"{self.path}/{old} cannot be renamed to {new}")

    def size(self, name: str) -> list[int]:
        """Number of files and bytes, added up by the file system."""
        found = self.files.getContentSummary(self.at(name))
        return [found.getFileCount(), found.getLength()]

    def write(self, name: str, text: str) -> None:
        """The text under a name that does not appear before all of it is written."""
        out = self.files.create(self.at(f"_{name}"), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        self.rename(f"_{name}", name)

    def read(self, name: str) -> str:
        source = self.files.open(self.at(name))
        text = bytes(source.readAllBytes()).decode("utf-8")
        source.close()
        return text

    def names(self, start: str) -> list[str]:
        if not self.exists(""):
            return []
        found = (status.getPath().getName() for status in self.files.listStatus(self.at("")))
        return sorted(name for name in found if name.startswith(start))


def put_in_place(folder: Folder, record: str) -> None:
    """Swap the tables a record names; swaps already made are passed over, so it may run again."""
    job = json.loads(folder.read(record))
    for name, size in job["tables"].items():
        fresh, old = f"_{name}.next-{job['id']}", f"_{name}.old-{job['id']}"
        if folder.exists(fresh):
            if folder.size(fresh) != size:
                raise OSError(f"{folder.path}/{fresh} is not the table that was recorded")
            if folder.exists(name):
                folder.rename(name, old)
            folder.rename(fresh, name)
        folder.delete(old)
    folder.delete(record)


def recover(spark: SparkSession, path: str) -> None:
    """Finish jobs that wrote their record but not all their swaps."""
    folder = Folder(spark, path)
    for record in folder.names(RECORD):
        put_in_place(folder, record)


class Publication:
    """The tables of one job, by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder, self.id, self.tables = Folder(spark, path), uuid.uuid4().hex, []

    def write(self, df: DataFrame, name: str) -> str:
        """Write a table beside its place; the folder it is in until it is published."""
        self.tables.append(name)
        path = f"{self.folder.path}/_{name}.next-{self.id}"
        df.write.parquet(path)
        return path

    def withdraw(self) -> None:
        for name in self.tables:
            self.folder.delete(f"_{name}.next-{self.id}")

    def publish(self) -> None:
        sizes = {name: self.folder.size(f"_{name}.next-{self.id}") for name in self.tables}
        record = f"{RECORD}{self.id}"
        self.folder.write(record, json.dumps({"id": self.id, "tables": sizes}))
        put_in_place(self.folder, record)


@contextmanager
def publishing(spark: SparkSession, path: str) -> Iterator[Publication]:
    """Tables written inside appear in the folder at the end; an error inside leaves it as it was."""
    recover(spark, path)
    job = Publication(spark, path)
    try:
        yield job
    except BaseException:
        job.withdraw()
        raise
    if job.tables:
        job.publish()


def publish(df: DataFrame, path: str) -> None:
    """Write or replace one table.  It may be made from the table it replaces."""
    folder, _, name = path.rstrip("/").rpartition("/")
    with publishing(df.sparkSession, folder or ("/" if path.startswith("/") else ".")) as job:
        job.write(df, name)

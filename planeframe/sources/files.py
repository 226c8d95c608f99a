"""A data source of whole files, `planefiles`: rows (name, content). A write is staged file by file and committed as a
whole: a journal says what is to be put in place, and a later write or read finishes or drops what was left behind."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from planeframe.sources import movie

SCHEMA = "name string, content binary"
STAGING, JOURNAL = "_staging", "_journal.json"


def recover(folder: str) -> str:
    """Finishes a commit that was prepared, or drops files that were staged without one: 'finished', 'dropped' or 'clean'."""
    journal = os.path.join(folder, JOURNAL)
    if os.path.exists(journal):
        with open(journal) as f:
            plan = json.load(f)
        for staged, name in plan:
            if os.path.exists(os.path.join(folder, STAGING, staged)):
                os.replace(os.path.join(folder, STAGING, staged), os.path.join(folder, name))
        os.remove(journal)
        _emptied(folder)
        return "finished"
    return "dropped" if _emptied(folder) else "clean"


def _emptied(folder: str) -> int:
    staging, n = os.path.join(folder, STAGING), 0
    if os.path.isdir(staging):
        for name in os.listdir(staging):
            os.remove(os.path.join(staging, name))
            n += 1
        os.rmdir(staging)
    return n


@dataclass
class Staged(WriterCommitMessage):
    files: list


class Sink(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        recover(folder)

    def write(self, rows: Iterator) -> Staged:
        out = []
        os.makedirs(os.path.join(self.folder, STAGING), exist_ok=True)
        for r in rows:
            if os.path.basename(r["name"]) != r["name"] or r["name"].startswith("_"):
                raise ValueError(f"not a file's name: {r['name']}")
            staged = uuid.uuid4().hex  # a task that runs twice stages its files twice; one of them is committed
            with open(os.path.join(self.folder, STAGING, staged), "wb") as f:
                f.write(r["content"])
                f.flush()
                os.fsync(f.fileno())
            out.append((staged, r["name"]))
        return Staged(out)

    def commit(self, messages: list) -> None:
        plan = [f for m in messages if m for f in m.files]
        journal = os.path.join(self.folder, JOURNAL)
        with open(journal + ".new", "w") as f:
            json.dump(plan, f)
        os.replace(journal + ".new", journal)  # from here on the commit will be finished
        recover(self.folder)

    def abort(self, messages: list) -> None:
        _emptied(self.folder)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Source(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[File]:
        recover(self.folder)
        return [File(os.path.join(self.folder, n)) for n in sorted(os.listdir(self.folder)) if not n.startswith("_")]

    def read(self, partition: File) -> Iterator[tuple[str, bytes]]:
        with open(partition.path, "rb") as f:
            yield os.path.basename(partition.path), f.read()


class PlaneFiles(DataSource):
    """option `path`: a folder that the driver and all executors share."""

    @classmethod
    def name(cls) -> str:
        return "planefiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Source:
        return Source(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Sink:
        return Sink(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlaneFiles)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(movie, content, path) of all files under a path that Spark can read, in any store; movie numbers the paths."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.withColumn("movie", F.xxhash64("path"))


def movies(spark: SparkSession, path: str) -> DataFrame:
    """The index of every movie under a path."""
    files = scan(spark, path)
    return movie.index_of(files).join(files.select("movie", "path"), "movie")


def stream(spark: SparkSession, path: str, most: int = 16) -> DataFrame:
    """(path, content) of files that arrive, at most so many in a batch: readers are never ahead of what follows."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most).schema("path string, modificationTime timestamp, length bigint, content binary").load(path).select("path", "content")

"""Helpers shared by the corpus operators: column selection, shared storage, sizes."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Used only where the session names no shared folder (tests, a single machine).
LOCAL_SHARED = "/tmp/checkpoints"

#: A side of at most this many rows of a few numbers each may be broadcast (about 16 MB).
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []


def place(df: DataFrame, name: str) -> int:
    """Where the column stands: the first exact match, else the first that differs in case only."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        if at := [i for i, c in enumerate(df.columns) if same(c)]:
            return at[0]
    raise ValueError(f"no column {name!r} among {df.columns}")


def flat(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... so that names may repeat or differ in case only."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, even if other columns differ from them only in case or repeat a name."""
    return flat(df).select(*[F.col(f"c{place(df, n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a single machine needs none."""
    if path := spark.conf.get("spark.checkpoint.dir", ""):
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_SHARED


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage.

    The files outlive any executor; they are removed by drop_written() or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planeframe/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables materialize() has written."""
    return len(_written)


def drop_written(since: int, upto: int) -> None:
    """Removes the tables written from number `since` up to, but without, `upto`: nothing may read them any more."""
    for spark, path in _written[since:upto]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already  # noqa: BLE001
            return


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which the Python worker gives the memory that it no longer needs back to the system: workers
    live on for other stages, beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no GNU C library
            pass

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df (materialized, so that counting is cheap) has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows it; else Spark shuffles it."""
    return F.broadcast(df) if small(df, rows) else df

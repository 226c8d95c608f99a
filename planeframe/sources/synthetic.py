"""Synthetic planes: functions of the place alone as expressions; grain, which draws numbers in raster order, a frame a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("flat", "gradient", "grain", "detail", "mixed")
_MASK = (1 << 64) - 1


def luma(kind: str, x: Column, y: Column, w: int, h: int) -> Column:
    """The sample of a kind without noise, 10 bits before clamping."""
    div = lambda a, b: F.floor(a / F.lit(b)).cast("bigint")
    if kind == "flat":
        return (F.lit(320) + (div(x, 32) + div(y, 32)) % 3 * 6).cast("bigint")
    if kind == "gradient":
        return (F.lit(64) + div(x * 700, max(w - 1, 1)) + div(y * 300, max(h - 1, 1))).cast("bigint")
    if kind == "detail":
        checker = F.when((div(x, 8) + div(y, 8)) % 2 == 0, 180).otherwise(760)
        return (checker + F.when((x + y) % 16 < 2, 200).otherwise(0)).cast("bigint")
    raise ValueError(f"{kind} is not a function of the place")


def planes(spark: SparkSession, frames: int, kind: str, w: int, h: int, depth: int = 10) -> DataFrame:
    """(f, y, s): luma rows of a kind that follows from the place."""
    top, scale = (1 << depth) - 1, 1 << (depth - 10)
    rows = spark.range(frames * h).select(F.floor(F.col("id") / h).cast("bigint").alias("f"), (F.col("id") % h).alias("y"))
    at = lambda x: F.least(F.greatest(luma(kind, x.cast("bigint"), F.col("y"), w, h) * scale, F.lit(0)), F.lit(top)).cast("bigint")
    return rows.withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(w - 1)), at))


def draws(seed: int, n: int) -> np.ndarray:
    """n numbers of a xorshift generator with a multiplied output, after eight that are thrown away."""
    out, x = np.empty(n, np.uint64), seed & _MASK
    for i in range(-8, n):
        x ^= x >> 12
        x = (x ^ x << 25) & _MASK
        x ^= x >> 27
        if i >= 0:
            out[i] = x * 0x2545F4914F6CDD1D & _MASK
    return out


#: What the seed is mixed with for luma; a fixed value.
LUMA = 0x4D4F565549564531


def grain(seeds: DataFrame, w: int, h: int) -> DataFrame:
    """(f, y, s) of seeds(f, seed): low frequencies and noise of six either way."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[0:h, 0:w]
        base = 350 + (x // 48 + y // 48) % 4 * 40
        for batch in batches:
            for f, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                noise = (draws(seed ^ LUMA, w * h) % np.uint64(13)).astype(np.int64).reshape(h, w) - 6
                rows = np.clip(base + noise, 0, 1023)
                yield pa.RecordBatch.from_arrays([pa.array([f] * h, pa.int64()), pa.array(range(h), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["f", "y", "s"])

    return seeds.select("f", "seed").mapInArrow(work, "f bigint, y bigint, s array<bigint>")

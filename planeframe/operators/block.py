"""8 x 8 blocks as arrays of 64 integers: transform, quantiser, scan, run/level pairs, Rice bits.

All work on one row at a time and shuffle nothing: expressions, but for the transforms, which take Arrow batches.
Blocks are (…keys, coef ARRAY<BIGINT>).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planeframe import tables as T


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column, computed once for each row: the one-row generator keeps the optimizer from copying
    the expression into each of its uses."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def batched(df: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with coef turned by f, which sees many blocks at once (blocks x 64) as an Arrow batch. The transform's 1,024
    products a block cost some microseconds so; as nested lambda expressions, which Spark interprets, half a millisecond."""
    at, names = df.columns.index("coef"), df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = f(np.asarray(batch.column(at).flatten(), np.int64).reshape(-1, 64))
            n, width = x.shape
            made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], names)

    return df.withColumn("coef", F.col("coef").cast("array<bigint>")).mapInArrow(work, df.withColumn("coef", F.col("coef").cast("array<bigint>")).schema)


def _rounded(a: np.ndarray) -> np.ndarray:
    """Divided by 2^32, halves away from zero."""
    half = np.int64(1) << np.int64(31)
    return np.where(a >= 0, a + half >> np.int64(32), -(half - a >> np.int64(32)))


_M, _W = np.array(T.M, np.int64), np.array([T.weight(u, v) for u in range(8) for v in range(8)], np.int64)


def transformed(x: np.ndarray) -> np.ndarray:
    """The transform of blocks x 64."""
    return (_M @ x.reshape(-1, 8, 8) @ _M.T).reshape(-1, 64)


def restored(x: np.ndarray) -> np.ndarray:
    """The inverse transform of blocks x 64."""
    return _rounded((_M.T @ (x * _W).reshape(-1, 8, 8) @ _M).reshape(-1, 64))


def level_shift(df: DataFrame, samples: Column, depth: int = 10) -> DataFrame:
    """coef: samples less half of the range."""
    half = 1 << (depth - 1)
    return held(df, "coef", F.transform(samples, lambda s: s.cast("bigint") - F.lit(half)))


def forward(df: DataFrame) -> DataFrame:
    """F = M x M^T, exact."""
    return batched(df, transformed)


def inverse(df: DataFrame) -> DataFrame:
    """M^T (F * W) M, divided by 2^32 with halves away from zero."""
    return batched(df, restored)


def _steps(qp: int, matrix: int, chroma: bool, refined: bool) -> Column:
    return F.array(*[F.lit(T.step(matrix, chroma, i, qp, refined)).cast("bigint") for i in range(64)])


def quantise(df: DataFrame, qp: int, matrix: int = 0, chroma: bool = False, refined: bool = False) -> DataFrame:
    """Dead-zone quantiser: no dead zone for DC, a quarter step for AC."""
    steps = _steps(qp, matrix, chroma, refined)
    most = F.lit(T.MAX_COEFFICIENT).cast("bigint")

    def one(f: Column, i: Column) -> Column:
        q = F.get(steps, i)
        num = F.least(F.abs(f), most) + F.shiftright(q, 1)
        dead = F.when(i == 0, F.lit(0)).otherwise(F.shiftright(q, 2)).cast("bigint")
        size = F.when(num > dead, F.floor((num - dead) / q)).otherwise(F.lit(0).cast("bigint"))
        return F.when(f < 0, -size).otherwise(size)

    return held(df, "coef", F.transform("coef", one))


def dequantise(df: DataFrame, qp: int, matrix: int = 0, chroma: bool = False, refined: bool = False) -> DataFrame:
    steps, most = _steps(qp, matrix, chroma, refined), F.lit(T.MAX_COEFFICIENT).cast("bigint")
    return df.withColumn("coef", F.transform("coef", lambda c, i: F.greatest(F.least(c * F.get(steps, i), most), -most)))


def predistort(df: DataFrame) -> DataFrame:
    """coef divided by the error that rounding leaves in the inverse's weights, halves away from zero: the decoder's
    gain is then exact, also for 16-bit samples."""
    gain = F.array(*[F.lit(T.weight(u, v) * T.E[u] * T.E[v]).cast("bigint") for u in range(8) for v in range(8)])

    def one(f: Column, i: Column) -> Column:
        g = F.get(gain, i)
        size = F.call_function("div", F.abs(f) * F.lit(1 << 33) + g, g * 2)
        return F.when(f < 0, -size).otherwise(size)

    return held(df, "coef", F.transform("coef", one))


def inverse_at(df: DataFrame, cells: list[tuple[int, int]], limit: int = 63) -> DataFrame:
    """coef: only the samples at the given (x, y), from the coefficients up to a scan position. Other coefficients are
    not looked at: a half-size frame reads 25 of 64."""
    order = T.zigzag()[: limit + 1]
    gain = np.array([[T.weight(i // 8, i % 8) * T.M[i // 8][y] * T.M[i % 8][x] for i in order] for x, y in cells], np.int64)
    return batched(df, lambda x: _rounded(x[:, order] @ gain.T))


def scan(df: DataFrame) -> DataFrame:
    """coef in zigzag order."""
    order = F.array(*[F.lit(i) for i in T.zigzag()])
    return held(df, "coef", F.transform(order, lambda i: F.get("coef", i)))


def unscan(df: DataFrame) -> DataFrame:
    """coef in natural order, from zigzag order."""
    place = {i: p for p, i in enumerate(T.zigzag())}
    order = F.array(*[F.lit(place[i]) for i in range(64)])
    return held(df, "coef", F.transform(order, lambda i: F.get("coef", i)))


def run_level(df: DataFrame) -> DataFrame:
    """pairs: (run of zeros, level) for each non-zero AC coefficient of a scanned block; DC is position 0.

    A block's pairs are followed by an end mark that is not stored (run 63)."""
    spots = F.filter(F.transform(F.slice("coef", 2, 63), lambda c, i: F.struct(i.alias("at"), c.alias("level"))), lambda x: x["level"] != 0)
    df = df.withColumn("spots", spots)
    df = held(df, "spots", spots)
    pairs = F.transform(
        "spots", lambda x, i: F.struct((x["at"] - F.when(i == 0, -1).otherwise(F.get("spots", i - 1)["at"]) - 1).cast("bigint").alias("run"), x["level"].alias("level"))
    )
    return held(df, "pairs", pairs).drop("spots")


def fold(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.when(v >= 0, v * 2).otherwise(-v * 2 - 1)


def unfold(m: Column) -> Column:
    return F.when(m % 2 == 0, F.floor(m / 2)).otherwise(-F.floor((m + 1) / 2))


def rice_k(total: Column, count: Column) -> Column:
    """floor(log2(total div count)) by integer thresholds, 0 to 14; 0 if there is nothing."""
    mean = F.when((count > 0) & (total > 0), F.floor(total / count)).otherwise(F.lit(0))
    k = F.lit(0)
    for i in range(1, 15):
        k = F.when(mean >= (1 << i), F.lit(i)).otherwise(k)
    return k.cast("bigint")


def rice_bits(m: Column, k: Column) -> Column:
    """Bits of the bounded Rice code of m: 63 beyond a quotient of 30."""
    quotient = F.floor(m / F.pow(F.lit(2.0), k)).cast("bigint")
    return F.when(quotient <= 30, quotient + 1 + k).otherwise(F.lit(63)).cast("bigint")


def long_form(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each coefficient: keys, i, c."""
    return df.select(*keys, F.posexplode("coef").alias("i", "c")).select(*keys, F.col("i").cast("bigint").alias("i"), "c")

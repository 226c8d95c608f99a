"""Sample tables: prefix sums, run lengths, nearest sync, containment, extents, tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exclusive_sum(value: str, by: list[str], order: list[str]) -> Column:
    """Sum of the values before this row: offsets from sizes, pts from durations."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("bigint")


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, run, value, n): maximal runs of equal values, numbered from 1 along the order."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    df = df.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def prev_sync(idx: str, sync: Column, by: list[str]) -> Column:
    """The nearest index at or before each row that is a sync sample; null before the first."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(F.when(sync, F.col(idx))).over(w)


def uncontained(samples: DataFrame, ranges: DataFrame, by: list[str], width: int = 4096) -> DataFrame:
    """Samples (by, off, size) that lie in no range (by, lo, hi) of their own key.

    A sample lies in a range if, of all ranges that begin at or before it, the furthest end reaches its own. So there
    is no join: ranges and samples are put in order of their places once, cut into buckets of `width` bytes that are
    swept apart from each other, and what reaches in from the buckets before is a running maximum over buckets."""
    bucket = F.floor(F.col("at") / width).cast("bigint")
    r = ranges.select(*by, F.col("lo").alias("at"), F.lit(0).alias("kind"), F.col("hi"), F.lit(None).cast("bigint").alias("size"))
    s = samples.select(*by, F.col("off").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("hi"), F.col("size").cast("bigint"))
    both = r.unionByName(s).withColumn("_b", bucket)
    ends = r.withColumn("_b", bucket).groupBy(*by, "_b").agg(F.max("hi").alias("_hi"))
    # buckets without a range take the maximum of the last one before them
    places = both.select(*by, "_b").distinct().join(ends, [*by, "_b"], "left")
    before = places.withColumn("_before", F.max("_hi").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_hi")
    inside = F.max("hi").over(Window.partitionBy(*by, "_b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = both.withColumn("_in", inside).filter("kind = 1").join(before, [*by, "_b"])
    reach = F.greatest(F.coalesce("_in", F.lit(-1)), F.coalesce("_before", F.lit(-1)))
    return swept.filter(reach < F.col("at") + F.greatest(F.col("size"), F.lit(1))).select(*by, F.col("at").alias("off"), "size")


def extents(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, extent, off, size, n): samples that follow each other without a gap, read as one."""
    w = Window.partitionBy(*by).orderBy(*order)
    joined = F.col("off") == F.lag(F.col("off") + F.col("size")).over(w)
    df = df.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("extent", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*by, "extent").agg(F.min("off").alias("off"), F.sum("size").alias("size"), F.count("*").alias("n"))


def tiling(df: DataFrame, by: list[str], lo: str, height: str, total: str) -> DataFrame:
    """(by, ok): whether the bands cover 0..total exactly, in order, without gap or overlap."""
    w = Window.partitionBy(*by).orderBy(lo, height)
    df = df.withColumn("_ok", F.col(lo) == F.coalesce(F.lag(F.col(lo) + F.col(height)).over(w), F.lit(0)))
    ends = F.max(F.col(lo) + F.col(height)) == F.max(total)
    return df.groupBy(*by).agg((F.min(F.col("_ok").cast("int")) == 1).alias("_all"), ends.alias("_end")).select(*by, (F.col("_all") & F.col("_end")).alias("ok"))


def continuity(df: DataFrame, by: list[str], order: list[str]) -> Column:
    """Whether pts is the previous pts plus the previous duration (true for the first)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.coalesce(F.col("pts") == F.lag(F.col("pts") + F.col("dur")).over(w), F.lit(True))

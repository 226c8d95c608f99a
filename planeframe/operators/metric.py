"""Quality, rate and entropy statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def psnr(total_square: Column, n: Column, peak: float) -> Column:
    """10 log10(peak^2 / mse); 99.0 without samples or error."""
    mse = total_square / n
    return F.when((n == 0) | (total_square <= 0), F.lit(99.0)).otherwise(F.lit(10.0) * F.log10(F.lit(float(peak * peak)) / mse))


def nearest_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, p50, p95, p99): the 0-based places n div 2 and min((n * P + 99) div 100, n - 1) of the sorted values.

    Values are counted first (partial aggregates); places are found in the running counts of different values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("_to", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.least(F.floor((F.col("_n") * p + 99) / 100), F.col("_n") - 1)
    pick = lambda place: F.min(F.when(F.col("_to") > place, F.col(value)))
    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), pick(F.floor(F.col("_n") / 2)).alias("p50"), pick(at(95)).alias("p95"), pick(at(99)).alias("p99"))


def entropy_bits(df: DataFrame, by: list[str], symbol: str) -> DataFrame:
    """(by, n, bits): N log2 N - sum of c log2 c over the symbol counts; two partial aggregates."""
    counts = df.groupBy(*by, symbol).agg(F.count("*").alias("c"))
    n = F.sum("c")
    return counts.groupBy(*by).agg(n.alias("n"), (n * F.log2(n) - F.sum(F.col("c") * F.log2("c"))).alias("bits"))


def rd_interpolate(points: DataFrame, by: list[str], target: float) -> DataFrame:
    """(by, bpp, extrapolated): the rate at a target quality, log2-linear between the neighbours around it."""
    w = Window.partitionBy(*by).orderBy("psnr", "bpp")
    p = points.withColumn("p1", F.lead("psnr").over(w)).withColumn("b1", F.lead("bpp").over(w)).withColumn("_r", F.row_number().over(w))
    p = p.filter(F.col("p1").isNotNull())
    p = p.withColumn("_in", (F.col("psnr") <= target) & (F.lit(target) <= F.col("p1")))
    p = p.withColumn("_far", F.when(F.col("_in"), F.lit(0.0)).otherwise(F.least(F.abs(F.col("psnr") - target), F.abs(F.col("p1") - target))))
    near = p.groupBy(*by).agg(F.min(F.struct("_far", "_r", "psnr", "bpp", "p1", "b1", "_in")).alias("x")).select(*by, "x.*")
    t = F.when(F.col("p1") > F.col("psnr"), (F.lit(target) - F.col("psnr")) / (F.col("p1") - F.col("psnr"))).otherwise(F.lit(0.0))
    rate = F.pow(F.lit(2.0), F.log2("bpp") + t * (F.log2("b1") - F.log2("bpp")))
    return near.select(*by, rate.alias("bpp"), (~F.col("_in")).alias("extrapolated"))


def context_cost(df: DataFrame, by: list[str], context: str, symbol: str) -> DataFrame:
    """(by, bits): the entropy of the symbols given their context, contexts without symbols counting nothing."""
    return entropy_bits(df, [*by, context], symbol).groupBy(*by).agg(F.sum("bits").alias("bits"))


def adaptive_bits(plain: Column, *modelled: Column, signal: float = 2.0) -> Column:
    """The least of the plain cost and the modelled ones, which pay for their signal."""
    return F.least(plain, *[m - F.lit(signal) for m in modelled])


def cheapest(costs: list[tuple[str, Column]]) -> Column:
    """The name of the lowest cost; ties go to the earlier one."""
    out, low = F.lit(costs[0][0]), costs[0][1]
    for name, cost in costs[1:]:
        out, low = F.when(cost < low, F.lit(name)).otherwise(out), F.least(low, cost)
    return out


def complexity(samples: Column, every: int = 4) -> Column:
    """The mean difference between neighbours of every fourth sample of a row; 1 for rows too short for it."""
    n = F.floor((F.size(samples) + every - 1) / every).cast("int")
    diffs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.abs(F.get(samples, (i + 1) * every) - F.get(samples, i * every)))
    return F.when(n >= 2, F.aggregate(diffs, F.lit(0).cast("bigint"), lambda a, b: a + b) / (n - 1)).otherwise(F.lit(1.0))


def activity(coef: Column) -> Column:
    """The sum of all AC sizes."""
    return F.aggregate(F.slice(coef, 2, 63), F.lit(0).cast("bigint"), lambda a, c: a + F.abs(c))


_MASK = (1 << 64) - 1


def fingerprint(values: list[int], start: int = 0) -> int:
    """An order-sensitive fold of 64-bit values (a splitmix finaliser on each step), as an unsigned number."""
    h = start
    for v in values:
        z = v & _MASK
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        h = (h + 0x9E3779B97F4A7C15 & _MASK) ^ z ^ z >> 31
    return h

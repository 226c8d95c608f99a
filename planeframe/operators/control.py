"""Rate control over ordered frames: windows wherever the terms allow it, folds over short parts where they feed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WINDOW = 24


def cut(size: str, by: list[str], order: list[str], factor: float = 1.8) -> Column:
    """Whether the frame exceeds factor x the median of up to WINDOW frames before it, from the fifth frame on."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.sort_array(F.collect_list(size).over(w.rowsBetween(-WINDOW, -1)))
    n = F.size(before)
    at = lambda i: F.get(before, i.cast("int")).cast("double")
    median = F.when(n % 2 == 1, at(F.floor(n / 2))).otherwise((at(F.floor(n / 2) - 1) + at(F.floor(n / 2))) * 0.5)
    return F.coalesce((n >= 4) & (F.col(size) > F.lit(factor) * F.greatest(F.lit(1.0), median)), F.lit(False))


def window_term(size: str, target: Column, by: list[str], order: list[str]) -> Column:
    """8 log2(mean of the last WINDOW frames / target), clamped to 6, once half of the window is there."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - WINDOW, 0)
    term = F.lit(8.0) * F.log2(F.greatest(F.avg(size).over(w), F.lit(1e-9)) / target)
    return F.when(F.count("*").over(w) >= WINDOW // 2, F.greatest(F.lit(-6.0), F.least(F.lit(6.0), term))).otherwise(F.lit(0.0))


def integral_term(size: str, target: Column, by: list[str], order: list[str]) -> Column:
    """8 log2(total / (target * frames)) from the fifth frame on."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(w)
    return F.when(n > 4, F.lit(8.0) * F.log2(F.greatest(F.sum(size).over(w), F.lit(1e-9)) / (target * n))).otherwise(F.lit(0.0))


def sized_search(costs: DataFrame, by: list[str], most: Column, qp_max: int) -> DataFrame:
    """(by, qp): the smallest qp whose bytes fit, else qp_max. costs has (by, qp, bytes)."""
    return costs.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("bytes") <= most, F.col("qp"))), F.lit(qp_max).cast("bigint")).alias("qp"))


def basis_points(part: Column, whole: Column) -> Column:
    """round(10000 part / whole), halves up, saturated at 65535; null without a whole."""
    return F.when(whole > 0, F.least(F.floor((part * 20000 + whole) / (whole * 2)), F.lit(65535))).cast("bigint")


def debt(size: Column, target: int, by: list[str], order: list[str], lend: int = 3) -> tuple[Column, Column]:
    """The loan of each frame (overshoot up to lend x target; savings are negative), and, of a column `_loan` that
    holds it, the debt after each frame: it never falls below zero, so it is the running sum less its lowest point."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.least(size - target, F.lit(lend * target)), F.col("_sum") - F.least(F.min("_sum").over(w), F.lit(0))


def debt_ledger(df: DataFrame, by: list[str], order: list[str], target: int, lend: int = 3) -> DataFrame:
    """df with debt: overshoot is lent up to lend x target a frame; what is saved pays it back."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    loan, left = debt(F.col("size"), target, by, order, lend)
    return df.withColumn("_sum", F.sum(loan).over(w)).withColumn("debt", left.cast("bigint")).drop("_sum")


def clamped_walk(df: DataFrame, by: list[str], order: list[str], step: str, start: int, lo: int, hi: int, out: str, part: int = 4096) -> DataFrame:
    """df with `out`: start plus all steps so far, held between lo and hi after each of them.

    A stretch of steps maps any start to min(high, max(low, start + sum)). So stretches of `part` rows are summed up
    apart from each other, their starts follow from one short fold a sequence, and each is then walked by itself."""
    keys = [*by, "_part"]
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_part", F.floor((F.row_number().over(w) - 1) / part)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (*by, *order)]))).alias("_rows"))
    hold = lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), x)).cast("bigint")
    s = lambda x: x[step].cast("bigint")
    none = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-(1 << 40)).cast("bigint").alias("low"), F.lit(1 << 40).cast("bigint").alias("high"))
    first = F.aggregate("_rows", none, lambda f, x: F.struct((f["sum"] + s(x)).alias("sum"), hold(f["low"] + s(x)).alias("low"), hold(f["high"] + s(x)).alias("high")))
    parts = rows.withColumn("_f", first)
    begin = F.lit(start).cast("bigint")
    walked = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "_f"))).alias("_all"))
    through = lambda f, x: F.least(f["high"], F.greatest(f["low"], x + f["sum"]))
    starts = F.aggregate(
        "_all",
        F.struct(begin.alias("at"), F.expr("CAST(array() AS array<struct<p:bigint,at:bigint>>)").alias("out")),
        lambda acc, x: F.struct(through(x["_f"], acc["at"]).alias("at"), F.array_append(acc["out"], F.struct(x["_part"].alias("p"), acc["at"].alias("at"))).alias("out")),
        lambda acc: acc["out"],
    )
    at = walked.select(*by, F.explode(starts).alias("x")).select(*by, F.col("x.p").alias("_part"), F.col("x.at").alias("_at"))
    values = F.aggregate(
        "_rows",
        F.struct(F.col("_at").alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("out")),
        lambda acc, x: F.struct(hold(acc["at"] + s(x)).alias("at"), F.array_append(acc["out"], hold(acc["at"] + s(x))).alias("out")),
        lambda acc: acc["out"],
    )
    each = parts.join(at, keys).select(*by, F.explode(F.arrays_zip(F.col("_rows").alias("r"), values.alias("v"))).alias("x"))
    return each.select(*by, "x.r.*", F.col("x.v").alias(out)).select(*df.columns, out)


def qp_feedback(df: DataFrame, by: list[str], order: list[str], target: float, qp0: int = 40, qp_max: int = 95) -> DataFrame:
    """df with qp: the controller's next qp after each frame; proportional, window, integral and repayment terms, clamped
    to 4 (8 after a cut), rounded half to even. Every term is a window; only the bounds of qp depend on the qp before."""
    t = F.lit(max(1.0, float(target)))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    loan, left = debt(F.col("size"), int(target), by, order)
    df = df.withColumn("_sum", F.sum(loan).over(w)).withColumn("_debt", left).withColumn("_cut", cut("size", by, order))
    log = lambda x: F.lit(8.0) * F.log2(x)
    repay = F.when(F.col("_debt") > 0, F.least(F.lit(4.0), log(F.lit(1.0) + F.col("_debt") / (t * WINDOW)))).otherwise(F.lit(0.0))
    adjust = log(F.greatest(F.col("size"), F.lit(1)) / t) + F.lit(0.35) * window_term("size", t, by, order) + F.lit(0.15) * integral_term("size", t, by, order) + repay
    most = F.when(F.col("_cut"), F.lit(8.0)).otherwise(F.lit(4.0))
    df = df.withColumn("_step", F.rint(F.greatest(-most, F.least(most, adjust))).cast("bigint")).drop("_sum", "_debt", "_cut")
    return clamped_walk(df, by, order, "_step", qp0, 0, qp_max, "qp").drop("_step")


def frame_target(budget: Column, spent: Column, frames: Column, total: Column, share: tuple[int, int] = (97, 100)) -> Column:
    """Bytes of the next frame in budget mode: a share of what is left over the frames that are left, at least 1."""
    return F.greatest(F.lit(1), F.call_function("div", F.call_function("div", (budget - spent) * share[0], F.lit(share[1])), F.greatest(F.lit(1), total - frames))).cast("bigint")


def frame_types(df: DataFrame, by: list[str], order: list[str], length: int = 12, depth: int = 10) -> DataFrame:
    """df(by, order, mad, i_bytes, p_bytes) with segment and type: every segment of `length` frames begins with an I
    frame; later frames are P if their mean difference is small and they take fewer bytes than the last I frame.
    Segments don't depend on each other, and each holds `length` rows at most."""
    w = Window.partitionBy(*by).orderBy(*order)
    seg = df.withColumn("segment", F.floor((F.row_number().over(w) - 1) / length).cast("bigint"))
    rest = [c for c in df.columns if c not in (*by, *order)]
    rows = seg.groupBy(*by, "segment").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_r"))
    start = F.struct(F.lit(-1).cast("bigint").alias("last"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        p = (acc["last"] >= 0) & (x["mad"] < (1 << (depth - 6))) & (x["p_bytes"] < acc["last"])
        return F.struct(F.when(p, acc["last"]).otherwise(x["i_bytes"]).cast("bigint").alias("last"), F.array_append(acc["out"], F.when(p, "P").otherwise("I")).alias("out"))

    kinds = F.aggregate("_r", start, one, lambda acc: acc["out"])
    each = rows.select(*by, "segment", F.explode(F.arrays_zip(F.col("_r").alias("r"), kinds.alias("k"))).alias("x"))
    return each.select(*by, "segment", "x.r.*", F.col("x.k").alias("type"))


def anchors(df: DataFrame, by: list[str], idx: str, ratio: float = 1.8, cooldown: int = 8) -> DataFrame:
    """df(by, idx from 0, complexity) with anchor: frames whose complexity jumps by the ratio either way against the
    frame before, at least `cooldown` frames after the last anchor. Only the jumps are folded."""
    before = F.lag("complexity").over(Window.partitionBy(*by).orderBy(idx))
    jump = F.coalesce((F.col("complexity") > before * ratio) | (F.col("complexity") < before / ratio), F.lit(False))
    marked = df.withColumn("_jump", jump)
    taken = marked.filter("_jump").groupBy(*by).agg(F.array_sort(F.collect_list(F.col(idx).cast("bigint"))).alias("_at"))
    start = F.struct(F.lit(-16).cast("bigint").alias("last"), F.expr("CAST(array() AS array<bigint>)").alias("out"))
    chosen = F.aggregate("_at", start, lambda acc, i: F.when(i - acc["last"] >= cooldown, F.struct(i.alias("last"), F.array_append(acc["out"], i).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    picks = taken.select(*by, F.explode(chosen).alias(idx)).withColumn("anchor", F.lit(True))
    return marked.drop("_jump").join(picks, [*by, idx], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))


def base_policy(long_edge: Column, most: Column, requested: Column, stage: Column, writer: Column, size_pass: Column, speed_pass: Column, scalable: Column, band_only: Column) -> Column:
    """(selected, fallback): policies 0 scalable, 1 bands only, 2 guarded by size; stage 0 experimental, 2 default;
    fallbacks 0 none, 1 experimental, 2 no writer, 3 release gate, 4 size hint."""
    made = lambda s, f: F.struct((s if isinstance(s, Column) else F.lit(s)).cast("int").alias("selected"), F.lit(f).alias("fallback"))
    return (
        F.when((long_edge <= most) | (long_edge <= 4096) | (requested == 1), made(1, 0))
        .when(stage == 0, made(1, 1))
        .when(~writer, made(1, 2))
        .when((stage == 2) & ~(size_pass & speed_pass), made(1, 3))
        .when((requested == 2) & ((scalable == 0) | (band_only == 0) | (scalable > band_only)), made(1, 4))
        .otherwise(made(F.when(requested == 2, 2).otherwise(0), 0))
    )

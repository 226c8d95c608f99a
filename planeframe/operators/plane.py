"""Planes as rows of samples (…keys, y, s ARRAY<BIGINT>): horizontal work inside a row, vertical work between rows by
windows that carry whole rows, so that no sample is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planeframe import tables as T
from planeframe.operators import block, sample


def _rows(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("y")


def _zip(f, *arrays: Column) -> Column:
    """f over the items of arrays of one length."""
    first, rest = arrays[0], arrays[1:]
    return F.transform(first, lambda v, i: f(v, *[F.get(a, i) for a in rest]))


def crop(df: DataFrame, w: int, h: int) -> DataFrame:
    return df.filter(F.col("y") < h).withColumn("s", F.slice("s", 1, w))


def padded(df: DataFrame, keys: list[str], w: int, h: int) -> DataFrame:
    """Planes grown to w x h by their last column and row."""
    wide = df.withColumn("s", sample.pad(F.col("s"), w))
    last = F.max("y").over(Window.partitionBy(*keys))
    each = wide.withColumn("_last", last).withColumn("_y", F.explode(F.when(F.col("y") == F.col("_last"), F.sequence(F.col("y").cast("int"), F.lit(h - 1))).otherwise(F.array(F.col("y").cast("int")))))
    return each.withColumn("y", F.col("_y").cast("bigint")).drop("_y", "_last")


# ---- deblocking ---------------------------------------------------------------------------------------------

#: Numerator and denominator of the step from the quantiser scale, bounds of the gate.
STEP, LEAST, MOST = (3, 173056), 3, 48


def strength(qp: int, refined: bool = False) -> tuple[int, int, int]:
    """alpha, beta and clip of the filter at a qp."""
    step = max(1, (T.qp_scale(qp, refined) * STEP[0] + STEP[1] // 2) // STEP[1])
    alpha = min(max(2 * step, LEAST), MOST)
    return alpha, alpha // 2 + 2, alpha >> 1


def _delta(p1: Column, p0: Column, q0: Column, q1: Column, qp: int, refined: bool) -> Column:
    """The correction across a boundary: 0 where the gate is shut; never past the middle of both sides."""
    alpha, beta, clip = strength(qp, refined)
    open_ = (F.abs(q0 - p0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)
    d = F.shiftright(((q0 - p0) * 12 + (p1 - q1) * 4 + 8).cast("bigint"), 4)
    up = F.greatest(F.least(d, F.shiftright(q0 - p0, 1)), F.lit(0))
    down = F.least(F.greatest(d, -F.shiftright(p0 - q0, 1)), F.lit(0))
    bounded = F.when(q0 >= p0, up).otherwise(down)
    return F.when(open_, F.greatest(F.least(bounded, F.lit(clip)), F.lit(-clip))).otherwise(F.lit(0)).cast("bigint")


def _moved(place: Column, v: Column, d: Column, most: int) -> Column:
    """The sample at a place (0 to 3: p1, p0, q0, q1) of a boundary with correction d."""
    half = F.shiftright(d, 1)
    out = F.when(place == 0, v + half).when(place == 1, v + d).when(place == 2, v - d).otherwise(v - half)
    return F.least(F.greatest(out, F.lit(0).cast("bigint")), F.lit(most).cast("bigint"))


def deblock(df: DataFrame, keys: list[str], w: int, h: int, qp: int, depth: int = 10, unit: int = 8, refined: bool = False) -> DataFrame:
    """Vertical boundaries of all rows, then horizontal ones; planes that are no multiples of the unit stay."""
    if w % unit or h % unit or w < 2 * unit or h < 2 * unit:
        return df
    most = (1 << depth) - 1

    def across(s: Column, i: Column) -> Column:
        edge = F.floor((i + 2) / unit).cast("int") * unit  # the boundary that the place belongs to
        place = i - edge + 2
        at = lambda k: F.get(s, edge + k)
        near = (place >= 0) & (place <= 3) & (edge > 0) & (edge < w)
        return F.when(near, _moved(place, F.get(s, i), _delta(at(-2), at(-1), at(0), at(1), qp, refined), most)).otherwise(F.get(s, i))

    out = block.held(df, "s", F.transform("s", lambda v, i: across(F.col("s"), i)))
    o = _rows(keys)
    edge = (F.floor((F.col("y") + 2) / unit) * unit).cast("bigint")
    near = {k: F.lag("s", k).over(o) if k > 0 else F.lead("s", -k).over(o) for k in (3, 2, 1, -1, -2, -3)}
    out = out.select("*", (F.col("y") - edge + 2).alias("_p"), edge.alias("_e"), *[x.alias(f"_r{k}") for k, x in near.items()])
    row = lambda k: F.col("s") if k == 0 else F.col(f"_r{k}")  # noqa: E731  k rows above
    pick = lambda i: F.when(F.col("_p") == 0, row(-i)).when(F.col("_p") == 1, row(1 - i)).when(F.col("_p") == 2, row(2 - i)).otherwise(row(3 - i))
    new = _zip(lambda v, p1, p0, q0, q1: _moved(F.col("_p"), v, _delta(p1, p0, q0, q1, qp, refined), most), F.col("s"), pick(0), pick(1), pick(2), pick(3))
    inside = (F.col("_p") <= 3) & (F.col("_e") > 0) & (F.col("_e") < h)
    return out.withColumn("s", F.when(inside, new).otherwise(F.col("s"))).drop("_p", "_e", *[f"_r{k}" for k in near])


# ---- pyramids -----------------------------------------------------------------------------------------------


def analyse2(df: DataFrame, keys: list[str]) -> DataFrame:
    """One level of the lifting by two in both directions: (keys, band, y, s) with bands ll, hl (across), lh (down), hh."""
    low, detail = sample.lift2(F.col("s"))
    halves = df.select(*keys, "y", F.explode(F.array(F.struct(F.lit("l").alias("c"), low.alias("s")), F.struct(F.lit("h").alias("c"), detail.alias("s")))).alias("x")).select(*keys, "y", "x.c", "x.s")
    by = [*keys, "c"]
    w = _rows(by)
    near = halves.select("*", *[x.alias(n) for n, x in (("_n1", F.lead("s", 1).over(w)), ("_n2", F.lead("s", 2).over(w)), ("_b1", F.lag("s", 1).over(w)), ("_b2", F.lag("s", 2).over(w)))])
    # rows at even places become the low band, those at odd places the detail
    d = lambda even, odd, nxt: _zip(lambda o, e, n: o - sample.floor_div(e + F.coalesce(n, e), 2), odd, even, F.coalesce(nxt, even))
    zero = F.transform("s", lambda _: F.lit(0).cast("bigint"))
    above = F.when(F.col("_b1").isNotNull(), d(F.col("_b2"), F.col("_b1"), F.col("s"))).otherwise(zero)
    below = F.when(F.col("_n1").isNotNull(), d(F.col("s"), F.col("_n1"), F.col("_n2"))).otherwise(zero)
    low = _zip(lambda v, a, b: v + sample.floor_div(a + b + 2, 4), F.col("s"), above, below)
    detail = d(F.col("_b1"), F.col("s"), F.col("_n1"))
    out = near.select(*keys, F.when(F.col("y") % 2 == 0, F.concat(F.col("c"), F.lit("l"))).otherwise(F.concat(F.col("c"), F.lit("h"))).alias("band"), sample.floor_div(F.col("y"), 2).alias("y"), F.when(F.col("y") % 2 == 0, low).otherwise(detail).alias("s"))
    return out.withColumn("band", F.when(F.col("band") == "ll", "ll").when(F.col("band") == "hl", "hl").when(F.col("band") == "lh", "lh").otherwise("hh"))


def synthesise2(bands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, s) of the bands of analyse2."""
    b = bands.withColumn("c", F.substring("band", 1, 1)).withColumn("r", F.substring("band", 2, 1))
    by = [*keys, "c"]
    pairs = b.groupBy(*by, "y").agg(F.max(F.when(F.col("r") == "l", F.col("s"))).alias("low"), F.max(F.when(F.col("r") == "h", F.col("s"))).alias("d"))
    zero = F.transform("low", lambda _: F.lit(0).cast("bigint"))
    w = _rows(by)
    pairs = pairs.withColumn("_up", F.coalesce(F.lag("d").over(w), zero)).withColumn("_d", F.coalesce("d", zero))
    pairs = pairs.withColumn("e", _zip(lambda v, a, x: v - sample.floor_div(a + x + 2, 4), F.col("low"), F.col("_up"), F.col("_d")))
    pairs = pairs.withColumn("_next", F.lead("e").over(w))
    odd = _zip(lambda x, e, n: x + sample.floor_div(e + n, 2), F.col("d"), F.col("e"), F.coalesce("_next", "e"))
    rows = F.filter(F.array(F.struct((F.col("y") * 2).alias("y"), F.col("e").alias("s")), F.struct((F.col("y") * 2 + 1).alias("y"), F.when(F.col("d").isNotNull(), odd).alias("s"))), lambda x: x["s"].isNotNull())
    tall = pairs.select(*by, F.explode(rows).alias("x")).select(*by, "x.y", "x.s")
    both = tall.groupBy(*keys, "y").agg(F.max(F.when(F.col("c") == "l", F.col("s"))).alias("low"), F.max(F.when(F.col("c") == "h", F.col("s"))).alias("d"))
    both = block.held(both.withColumn("d", F.coalesce("d", F.expr("CAST(array() AS array<bigint>)"))), "e", sample.unlift2_even(F.col("low"), F.col("d")))
    return both.select(*keys, "y", sample.unlift2(F.col("e"), F.col("d")).alias("s"))


# ---- scaling in both directions -----------------------------------------------------------------------------


def area_down(df: DataFrame, keys: list[str], src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Overlap-weighted means over both directions, rounded once: a row's weighted sums first, then each target row
    sums up the few source rows that it overlaps."""
    (sw, sh), (dw, dh) = src, dst
    across = F.transform(F.sequence(F.lit(0), F.lit(dw - 1)), lambda d: sample.overlap_sum(F.col("s"), d, sw, dw))
    part = df.select(*keys, "y", across.alias("s"))
    first, last = F.floor(F.col("y") * dh / sh).cast("int"), F.floor(((F.col("y") + 1) * dh - 1) / sh).cast("int")
    each = part.withColumn("t", F.explode(F.sequence(first, last)))
    weight = F.least((F.col("t") + 1) * sh, (F.col("y") + 1) * dh) - F.greatest(F.col("t") * sh, F.col("y") * dh)
    cells = each.select(*keys, F.col("t").cast("bigint").alias("t"), weight.cast("bigint").alias("w"), F.posexplode("s").alias("i", "v"))
    area = sw * sh
    sums = cells.groupBy(*keys, "t", "i").agg(sample.floor_div(F.sum(F.col("v") * F.col("w")) + area // 2, area).alias("v"))
    rows = sums.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a"))
    return rows.select(*keys, F.col("t").alias("y"), F.transform("a", lambda x: x["v"]).alias("s"))


def bilinear_up(df: DataFrame, keys: list[str], src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Centre-aligned with rational weights in both directions, rounded once. Each target row meets its two source
    rows by a join on their number."""
    (sw, sh), (dw, dh) = src, dst
    left, part = sample.centre(F.col("id"), sh, dh)
    plan = df.sparkSession.range(dh).select(F.col("id").alias("_t"), left.alias("_a"), part.alias("_f")).withColumn("_b", F.least(F.col("_a") + 1, F.lit(sh - 1)))
    wide = df.select(*keys, "y", F.transform(F.sequence(F.lit(0), F.lit(dw - 1)), lambda d: sample.centre_sum(F.col("s"), d, sw, dw)).alias("s"))
    up = wide.join(F.broadcast(plan), F.col("y") == F.col("_a")).select(*keys, "_t", "_b", "_f", F.col("s").alias("_s0"))  # the plan has one row a target row
    both = up.join(wide.select(*keys, F.col("y").alias("_b"), F.col("s").alias("_s1")), [*keys, "_b"])
    den = 4 * dw * dh
    s = _zip(lambda p, q: sample.floor_div(p * (F.lit(2 * dh) - F.col("_f")) + q * F.col("_f") + den // 2, den), F.col("_s0"), F.col("_s1"))
    return both.select(*keys, F.col("_t").alias("y"), s.alias("s"))


def base_residual(df: DataFrame, base: DataFrame, keys: list[str], src: tuple[int, int], small: tuple[int, int], q: int) -> DataFrame:
    """(keys, y, s, pred, r): the quantised difference of the plane and its base scaled up."""
    up = bilinear_up(base, keys, small, src).withColumnRenamed("s", "pred")
    both = df.join(up, [*keys, "y"])
    return both.withColumn("r", F.zip_with("s", "pred", lambda a, b: sample.symmetric_quantise(a - b, q)))


def with_residual(df: DataFrame, q: int, depth: int) -> DataFrame:
    """s: pred and r put together again."""
    most = F.lit((1 << depth) - 1).cast("bigint")
    return df.withColumn("s", F.zip_with("pred", "r", lambda p, r: F.least(F.greatest(p + r * q, F.lit(0).cast("bigint")), most)))


# ---- prediction inside blocks -------------------------------------------------------------------------------

MODES = 8


def intra_candidates(top: Column, left: Column, corner: Column, mid: int) -> Column:
    """The eight predictions of a block: middle, mean, from above, from the left, planar, and three diagonals. top has
    16 samples, left has 8; null where the block has no such neighbour."""
    m = F.lit(mid).cast("bigint")
    t, lf = F.coalesce(top, F.array_repeat(m, 16)), F.coalesce(left, F.array_repeat(m, 8))
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0).cast("bigint"), lambda x, y: x + y)
    count = F.when(top.isNotNull(), 8).otherwise(0) + F.when(left.isNotNull(), 8).otherwise(0)
    # the mean counts the left side only where there is one, and the eight samples right above
    s = F.when(top.isNotNull(), total(t, 8)).otherwise(F.lit(0)) + F.when(left.isNotNull(), total(lf, 8)).otherwise(F.lit(0))
    mean = F.when(count > 0, F.floor((s + count / 2) / count)).otherwise(m).cast("bigint")
    c = F.when(top.isNotNull() & left.isNotNull(), corner).otherwise(m)

    def cell(k: Column, mode: int) -> Column:
        y, x = F.shiftright(k, 3), k.bitwiseAND(F.lit(7))
        a, b = (lambda i: F.get(t, i)), (lambda i: F.get(lf, i))
        if mode == 4:
            return F.floor(((7 - x) * b(y) + (x + 1) * a(F.lit(7)) + (7 - y) * a(x) + (y + 1) * b(F.lit(7)) + 8) / 16).cast("bigint")
        if mode == 5:
            return F.when(x > y, a(x - y - 1)).when(y > x, b(y - x - 1)).otherwise(c)
        return {0: m, 1: mean, 2: a(x), 3: b(y), 6: a(x + y + 1), 7: b(F.least(x + y + 1, F.lit(7)))}[mode]

    cells = F.sequence(F.lit(0), F.lit(63))
    def predicted(mode: int) -> Column:
        return F.transform(cells, lambda k: cell(k, mode))

    return F.array(*[predicted(mode) for mode in range(MODES)])


def intra_choice(candidates: Column) -> Column:
    """The mode of candidates (mode, bits, error): 0, unless one of the two cheapest others takes fewer bits than what
    is chosen so far without a larger error."""
    zero = F.get(F.filter(candidates, lambda c: c["mode"] == 0), F.lit(0))
    others = F.slice(F.array_sort(F.transform(F.filter(candidates, lambda c: c["mode"] != 0), lambda c: F.struct(c["bits"], c["mode"], c["error"]))), 1, 2)
    start = F.struct(zero["bits"].alias("bits"), zero["mode"].alias("mode"), zero["error"].alias("error"))
    return F.aggregate(others, start, lambda acc, c: F.when((c["bits"] < acc["bits"]) & (c["error"] <= acc["error"]), F.struct(c["bits"].alias("bits"), c["mode"].alias("mode"), c["error"].alias("error"))).otherwise(acc), lambda acc: acc["mode"])

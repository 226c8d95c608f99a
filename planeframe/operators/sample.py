"""Sample planes: resampling, subsampling, lifting, prediction, conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def floor_div(a: Column, b: int) -> Column:
    """Floor division of integers, exact below 2^53."""
    return F.floor(a / F.lit(b)).cast("bigint")


def coded_dim(v: Column) -> Column:
    """The next multiple of 8; 0 outside 1..16384."""
    return F.when((v >= 1) & (v <= 16384), floor_div(v + 7, 8) * 8).otherwise(F.lit(0)).cast("bigint")


def pad(samples: Column, n: int) -> Column:
    """The array with its last sample repeated up to n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(samples, F.least(i, F.size(samples) - 1)))


def pairs_422(samples: Column) -> Column:
    """Halved horizontally: (a + b + 1) >> 1; an odd last sample pairs with itself."""
    n = F.size(samples)
    return F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: F.shiftright(F.get(samples, i * 2) + F.get(samples, F.least(i * 2 + 1, n - 1)) + 1, 1)
    )


def overlap_sum(samples: Column, d: Column, src: int, dst: int) -> Column:
    """The samples under target d, each times its overlap on the common grid of src x dst parts."""
    first, last = F.floor(d * src / dst).cast("int"), F.floor(((d + 1) * src - 1) / dst).cast("int")
    weight = lambda s: (F.least((d + 1) * src, (s + 1) * dst) - F.greatest(d * src, s * dst)).cast("bigint")
    return F.aggregate(F.sequence(first, last), F.lit(0).cast("bigint"), lambda acc, s: acc + F.get(samples, s) * weight(s))


def area_down(samples: Column, src: int, dst: int) -> Column:
    """Overlap-weighted means on the common grid, rounded half up."""
    return F.transform(F.sequence(F.lit(0), F.lit(dst - 1)), lambda d: floor_div(overlap_sum(samples, d, src, dst) + src // 2, src))


def centre(d: Column, src: int, dst: int) -> tuple[Column, Column]:
    """The left source sample of target d, and the right one's weight in parts of 2 * dst; ends are clamped."""
    num = F.greatest((d * 2 + 1) * src - dst, F.lit(0))
    left = F.floor(num / (2 * dst)).cast("bigint")
    over = left >= src - 1
    return F.when(over, F.lit(src - 1)).otherwise(left).cast("bigint"), F.when(over, F.lit(0)).otherwise(num % (2 * dst)).cast("bigint")


def centre_sum(samples: Column, d: Column, src: int, dst: int) -> Column:
    """Both source samples times their weights, which sum up to 2 * dst."""
    left, part = centre(d, src, dst)
    return F.get(samples, left.cast("int")) * (F.lit(2 * dst) - part) + F.get(samples, F.least(left + 1, F.lit(src - 1)).cast("int")) * part


def bilinear_up(samples: Column, src: int, dst: int) -> Column:
    """Centre-aligned, rational weights, rounded half up, ends clamped."""
    return F.transform(F.sequence(F.lit(0), F.lit(dst - 1)), lambda d: floor_div(centre_sum(samples, d, src, dst) + dst, 2 * dst))


def nearest(samples: Column, src: int, dst: int) -> Column:
    """Target t takes source floor(t * src / dst)."""
    return F.transform(F.sequence(F.lit(0), F.lit(dst - 1)), lambda t: F.get(samples, F.floor(t * src / dst).cast("int")))


def lift2(samples: Column) -> tuple[Column, Column]:
    """Low and detail bands of the reversible two-tap lifting, for an array of any length."""
    n = F.size(samples)
    at = lambda i: F.get(samples, i)
    halves = F.when(n >= 2, F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    detail = F.transform(halves, lambda j: at(j * 2 + 1) - floor_div(at(j * 2) + F.when(j * 2 + 2 < n, at(j * 2 + 2)).otherwise(at(j * 2)), 2))
    return F.transform(
        F.sequence(F.lit(0), F.floor((n + 1) / 2).cast("int") - 1),
        lambda j: at(j * 2)
        + floor_div(F.when(j > 0, F.get(detail, j - 1)).otherwise(F.lit(0)) + F.when(j < F.size(detail), F.get(detail, j)).otherwise(F.lit(0)) + 2, 4),
    ), detail


def unlift2_even(low: Column, detail: Column) -> Column:
    """The samples at even places, from both bands of lift2."""
    return F.transform(
        low,
        lambda v, j: v - floor_div(F.when(j > 0, F.get(detail, j - 1)).otherwise(F.lit(0)) + F.when(j < F.size(detail), F.get(detail, j)).otherwise(F.lit(0)) + 2, 4),
    )


def unlift2(even: Column, detail: Column) -> Column:
    """All samples, from those at even places and the details."""
    odd = lambda j: F.get(detail, j) + floor_div(F.get(even, j) + F.coalesce(F.get(even, j + 1), F.get(even, j)), 2)
    return F.flatten(F.transform(even, lambda e, j: F.when(j < F.size(detail), F.array(e, odd(j))).otherwise(F.array(e))))


def lift3(samples: Column) -> tuple[Column, Column, Column]:
    """Low and two details of the reversible three-tap lifting, of an array of any length: in the last group the last
    sample stands in for those that are missing."""
    n = F.size(samples)
    groups = F.sequence(F.lit(0), F.floor((n + 2) / 3).cast("int") - 1)
    at = lambda j, k: F.get(samples, F.least(j * 3 + k, n - 1))
    d0, d1 = F.transform(groups, lambda j: at(j, 0) - at(j, 1)), F.transform(groups, lambda j: at(j, 2) - at(j, 1))
    return F.transform(groups, lambda j: at(j, 1) + floor_div(at(j, 0) + at(j, 2) - at(j, 1) * 2 + 1, 3)), d0, d1


def unlift3(low: Column, d0: Column, d1: Column, n: Column) -> Column:
    """n samples from the bands of lift3."""
    group = lambda v, j: F.array(
        v - floor_div(F.get(d0, j) + F.get(d1, j) + 1, 3) + F.get(d0, j), v - floor_div(F.get(d0, j) + F.get(d1, j) + 1, 3), v - floor_div(F.get(d0, j) + F.get(d1, j) + 1, 3) + F.get(d1, j)
    )
    return F.slice(F.flatten(F.transform(low, group)), F.lit(1), n)


def half_to_code(h: Column) -> Column:
    """Bit patterns of half floats to a code that keeps their order; both zeros meet at 0x8000."""
    return F.when(h < 0x8000, h + 0x8000).otherwise(F.lit(0x8000) - h.bitwiseAND(F.lit(0x7FFF))).cast("bigint")


def code_to_half(code: Column) -> Column:
    return F.when(code == 0, F.lit(0xFFFF)).when(code >= 0x8000, code - 0x8000).otherwise(F.lit(0x8000).bitwiseOR(F.lit(0x8000) - code)).cast("bigint")


def alpha_quantise(a: Column, shift: int) -> Column:
    """The nearest multiple of 2^shift, clamped to the largest below 2^16."""
    step = 1 << shift
    return F.least(floor_div(a + step // 2, step) * step, F.lit(65535 - 65535 % step)).cast("bigint")


def symmetric_quantise(v: Column, q: int) -> Column:
    size = floor_div(F.abs(v) + q // 2, q)
    return F.when(v < 0, -size).otherwise(size)


def med_residuals(samples: Column, width: int) -> Column:
    """(pred, resid) of each sample of a band by the median edge detector: first row from the left, first column from
    above, corner 0. All neighbours lie in the same array."""

    def one(v: Column, i: Column) -> Column:
        left, top = (F.get(samples, i - k) for k in (1, width))
        corner = F.get(samples, i - width - 1)
        hi, lo = F.greatest(left, top), F.least(left, top)
        inner = F.when(corner >= hi, lo).when(corner <= lo, hi).otherwise(left + top - corner)
        pred = F.when(i == 0, F.lit(0)).when(i < width, left).when(i % width == 0, top).otherwise(inner).cast("bigint")
        return F.struct(pred.alias("pred"), (v - pred).cast("bigint").alias("resid"))

    return F.transform(samples, one)


def rgb_to_yuv(df: DataFrame) -> DataFrame:
    """BT.709 in single precision, full range, 10 bits: y, u, v from r, g, b (FLOAT, 0..1). Every step rounds to FLOAT."""
    f = lambda x: F.lit(x).cast("float")
    div = lambda a, b: (a / b).cast("float")
    kr, kg, kb = f(0.2126), f(0.7152), f(0.0722)
    df = df.withColumn("yf", kr * F.col("r") + kg * F.col("g")).withColumn("yf", F.col("yf") + kb * F.col("b"))
    clip = lambda c: F.greatest(F.least(F.rint(c), F.lit(1023.0)), F.lit(0.0)).cast("bigint")
    return df.select(
        "*",
        clip(F.col("yf") * f(1023.0)).alias("y"),
        clip(div(F.col("b") - F.col("yf"), f(1.8556)) * f(1023.0) + f(512.0)).alias("u"),
        clip(div(F.col("r") - F.col("yf"), f(1.5748)) * f(1023.0) + f(512.0)).alias("v"),
    ).drop("yf")


FORMATS = ("bgr24", "rgb24", "bgra32", "rgba32", "bgr48", "rgb48", "bgra64", "rgba64")


def unpacked(row: Column, fmt: str) -> Column:
    """(r, g, b, a) of each pixel of a packed row (bytes; 16-bit samples are little-endian); a is null without alpha."""
    channels, size = (4 if "a" in fmt else 3), (2 if fmt.endswith(("48", "64")) else 1)
    order = fmt.rstrip("0123456789")
    byte = lambda k: F.conv(F.hex(F.substring(row, k + 1, F.lit(1))), 16, 10).cast("bigint")
    value = lambda k: byte(k) if size == 1 else byte(k) + byte(k + 1) * 256
    pixels = F.sequence(F.lit(0), F.floor(F.octet_length(row) / (channels * size)).cast("int") - 1)
    pick = lambda x, c: value((x * channels + order.index(c)) * size) if c in order else F.lit(None).cast("bigint")
    return F.transform(pixels, lambda x: F.struct(*[pick(x, c).alias(c) for c in "rgba"]))


def converted(pixels: Column, out: str, peak: int, depth: int = 10, shift: int = 0, full: bool = True, kr: float = 0.2126, kb: float = 0.0722) -> tuple[Column, Column, Column, Column]:
    """The planes (Y U V or G B R, and alpha) of a row of pixels (r, g, b, a: 0..peak); out is 422, 444 or gbr. Every
    step rounds to FLOAT, in a fixed order; 4:2:2 halves the quantised chroma, halves to even."""
    f = lambda x: F.lit(x).cast("float")
    scale, move = (1 << depth) - 1, 1 << (depth - 8)
    y_mult, y_off, c_mult, c_off = (scale, 0, scale, 0) if full else (219 * move, 16 * move, 224 * move, 16 * move)
    clip = lambda v: F.greatest(F.least(F.rint(v), F.lit(float(scale))), F.lit(0.0)).cast("bigint")
    part = lambda p, c: (p[c].cast("float") / f(peak)).cast("float")
    luma = lambda p: f(kr) * part(p, "r") + f(1 - kr - kb) * part(p, "g") + f(kb) * part(p, "b")
    chroma = lambda p, c, k: clip((((part(p, c) - luma(p)) / f(2 * (1 - k))).cast("float") + f(0.5)) * f(c_mult) + f(c_off))
    most = (1 << (16 - shift)) - 1
    opaque = F.lit(most << shift).cast("bigint")
    alpha = F.transform(pixels, lambda p: F.coalesce(F.shiftleft(F.greatest(F.least(F.rint(part(p, "a") * f(most)), F.lit(float(most))), F.lit(0.0)).cast("bigint"), shift), opaque))
    if out == "gbr":
        direct = lambda c: F.transform(pixels, lambda p: clip(part(p, c) * f(scale)))
        return direct("g"), direct("b"), direct("r"), alpha
    u, v = F.transform(pixels, lambda p: chroma(p, "b", kb)), F.transform(pixels, lambda p: chroma(p, "r", kr))
    if out == "422":
        u, v = halved_even(u), halved_even(v)
    return F.transform(pixels, lambda p: clip(luma(p) * f(y_mult) + f(y_off))), u, v, alpha


def halved_even(samples: Column) -> Column:
    """Means of two, halves to even; an odd last sample stays."""
    n = F.size(samples)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: F.rint((F.get(samples, i * 2) + F.get(samples, F.least(i * 2 + 1, n - 1))) / 2).cast("bigint"))


def reconstructed(ref: Column, x: Column, mid: int) -> Column:
    """clip(ref + x - mid) of two sample arrays."""
    return F.zip_with(ref, x, lambda a, b: F.greatest(F.lit(0).cast("bigint"), F.least(a + b - mid, F.lit(2 * mid - 1).cast("bigint"))))


def residual(cur: Column, ref: Column, mid: int) -> Column:
    """clip(cur - ref + mid) of two sample arrays."""
    return F.zip_with(cur, ref, lambda a, b: F.greatest(F.lit(0).cast("bigint"), F.least(a - b + mid, F.lit(2 * mid - 1).cast("bigint"))))


def conceal(samples: Column, bad: Column, neutral: int) -> Column:
    return F.when(bad, F.transform(samples, lambda _: F.lit(neutral).cast("bigint"))).otherwise(samples)


def fit_dims(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """The long edge becomes `most`, the other keeps the ratio (floor, at least 1); nothing grows."""
    long_ = F.greatest(w, h)
    keep = long_ <= most
    other = lambda a: F.greatest(F.floor(a * most / long_), F.lit(1)).cast("bigint")
    return (
        F.when(keep, w).when(w >= h, F.lit(most)).otherwise(other(w)).cast("bigint"),
        F.when(keep, h).when(h > w, F.lit(most)).when(w == h, F.lit(most)).otherwise(other(h)).cast("bigint"),
    )

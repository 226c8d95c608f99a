"""Rules as ordered predicates that yield a status (0, or that of the first violation), and the small tables behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planeframe.sources.packet import ALPHA, ARGUMENT, FORMAT, PROFILE, first_error

# Divisors of the decode scales and the last scan position that each needs.
SCALES = {0: (1, 63), 1: (2, 24), 2: (3, 16), 3: (4, 10), 4: (8, 4)}
#: Bits a pixel of the tiers, from their megabytes a second at 1080p25 (middle of the range).
TIERS = {"proxy": 1, "lt": 2, "standard": 3, "hq": 4, "4444": 5, "4444xq": 6, "lp": 7, "raw": 8}


def support_status(profile: Column, pixel_format: Column, depth: Column, alpha: Column) -> Column:
    return first_error(
        [
            (~profile.isin(3, 5, 6, 7), PROFILE),
            ((pixel_format > 3) | ~depth.isin(10, 12, 16), FORMAT),
            ((profile == 7) != (pixel_format == 3), FORMAT),
            ((profile == 7) & (~depth.isin(12, 16) | (alpha != 0)), FORMAT),
            (profile.isin(5, 6) & (pixel_format == 0), FORMAT),
            ((profile == 6) & (depth != 12), FORMAT),
            (alpha > 2, ALPHA),
        ]
    )


def capabilities(df: DataFrame) -> DataFrame:
    """The combinations (profile, pixel_format, bit_depth, alpha_mode) that can be coded, as a small dimension table."""
    spark = df.sparkSession
    grid = spark.range(8).select(F.col("id").alias("profile"))
    for name, values in (("pixel_format", range(4)), ("bit_depth", (10, 12, 16)), ("alpha_mode", range(3))):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.filter(support_status(F.col("profile"), F.col("pixel_format"), F.col("bit_depth"), F.col("alpha_mode")) == 0)


def config_status(c: Column) -> Column:
    """Domain and cross-field rules of a frame configuration (a struct). coding: 0, 1 or 8 to 11 may be written; its
    extra fields (x3 to x7) must be 0 but where the coding gives them a meaning."""
    g = lambda n: c[n]
    temporal = g("coding") >= 10
    first_free = F.when(temporal, 6).when(g("coding") == 9, 5).otherwise(3)
    unused = F.lit(False)
    for i in range(3, 8):
        unused = unused | ((F.lit(i) >= first_free) & (g(f"x{i}") != 0) & ~((g("coding") == 8) & F.lit(i == 5)))
    return first_error(
        [
            (~g("width").between(1, 16384) | ~g("height").between(1, 16384), ARGUMENT),
            (g("qp") > 95, ARGUMENT),
            ((g("coding") > 11) | g("coding").between(2, 7), ARGUMENT),
            ((g("aq") > 1) | (g("rdo") > 1), ARGUMENT),
            (unused, ARGUMENT),
            ((g("coding") == 8) & (g("x5") != 0) & ((g("x5") > 3) | (g("profile") != 3) | (g("pixel_format") != 0) | (g("bit_depth") != 10)), ARGUMENT),
            (temporal & ((g("x3") > 1) | (g("x5") != g("x3"))), ARGUMENT),
            (g("alpha_mode") > 2, ARGUMENT),
            ((g("alpha_mode") == 1) & (g("alpha_bit_depth") != 16), ARGUMENT),
            ((g("alpha_mode") == 2) & ~g("alpha_bit_depth").isin(8, 10, 12), ARGUMENT),
            ((g("pixel_format") == 3) & ((g("alpha_mode") != 0) | (g("qp_delta_chroma") != 0)), ARGUMENT),
            (support_status(g("profile"), g("pixel_format"), g("bit_depth"), g("alpha_mode")) == PROFILE, PROFILE),
            ((g("bit_depth") >= 13) & ~g("coding").isin(8, 9), ARGUMENT),
        ]
    )


def request_status(mode: Column, quality: Column, memory: Column, flags: Column, scale: Column, w: Column, h: Column) -> Column:
    """A decode request: mode 0 full, 1 scaled to a target, 2 reduced by a scale, 3 automatic; 0 or -1."""
    bad = (
        (mode > 3) | (quality > 2) | ~memory.isin(0, 1) | (flags > 1) | ((w == 0) != (h == 0))
        | ((mode == 0) & ((scale != 0) | (w != 0))) | ((mode == 1) & ((scale != 0) | (w == 0)))
        | ((mode == 2) & ((scale > 4) | (w != 0))) | ((mode == 3) & (scale != 0))
    )
    return F.when(bad, ARGUMENT).otherwise(0).cast("int")


def scaled_dims(w: Column, h: Column, scale: Column) -> tuple[Column, Column, Column]:
    """Width and height (rounded up) and the last scan position of a reduced decode; null for unknown scales."""
    up = lambda v, d: F.floor((v + d - 1) / d).cast("bigint")
    divisor, limit = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (d, n) in SCALES.items():
        divisor, limit = F.when(scale == k, d).otherwise(divisor), F.when(scale == k, n).otherwise(limit)
    return up(w, divisor), up(h, divisor), limit


def request_plan(h: Column, mode: Column, scale: Column, w: Column, hh: Column, flags: Column) -> Column:
    """What a valid request means for a header's frame: (width, height, coefficient_limit, drop_alpha). Automatic mode
    takes a target if there is one, else the least reduction whose long edge is 2048 or less."""
    width, height = h["visible_width"], h["visible_height"]
    long_ = F.greatest(width, height)
    auto = F.lit(4)
    for k in (3, 2, 1, 0):
        auto = F.when(F.floor((long_ + SCALES[k][0] - 1) / SCALES[k][0]) <= 2048, k).otherwise(auto)
    target = (mode == 1) | ((mode == 3) & (w > 0))
    at = F.when(mode == 2, scale).when(mode == 3, auto).otherwise(0)
    rw, rh, limit = scaled_dims(width, height, at)
    return F.struct(
        F.when(target, w).otherwise(rw).cast("bigint").alias("width"),
        F.when(target, hh).otherwise(rh).cast("bigint").alias("height"),
        F.when(target, 63).otherwise(limit).cast("bigint").alias("coefficient_limit"),
        ((flags == 1) & (h["alpha_mode"] != 0)).alias("drop_alpha"),
    )


def same_config(h: Column, c: Column, names: tuple[str, ...] = ("profile", "pixel_format", "bit_depth", "alpha_mode", "alpha_bit_depth", "color_primaries", "color_transfer", "color_matrix", "chroma_siting", "sar_num", "sar_den")) -> Column:
    """Whether a packet's header says the same as its movie's configuration; the qp may differ from frame to frame."""
    out = F.lit(True)
    for n in names:
        out = out & h[n].eqNullSafe(c[n])
    return out


def pixel_format_of(name: Column) -> Column:
    """(pixel_format, bit_depth, alpha_depth) of a pixel format's name; null for names of another kind."""
    chroma = F.when(name.rlike(r"yuva?422p"), 0).when(name.rlike(r"yuva?444p"), 1).when(name.rlike(r"gbra?p\d"), 2)
    depth = F.regexp_extract(name, r"(?:4[24]{2}|gbra?)p(\d+)", 1)
    alpha = F.regexp_extract(name, r"a(\d+)$", 1)
    number = lambda t: F.when(t != "", t.cast("int"))
    return F.when(chroma.isNotNull() & (depth != ""), F.struct(chroma.cast("int").alias("pixel_format"), number(depth).alias("bit_depth"), number(alpha).alias("alpha_depth")))


def tier_label(tier: Column, depth: Column, floating: Column) -> Column:
    """The display name of an image tier (1 low to 4 ultra) at a depth; null for others."""
    name = F.when(tier == 1, "Low").when(tier == 2, "Medium").when(tier == 3, "High").when(tier == 4, "Ultra")
    return F.when(name.isNotNull(), F.concat(name, F.lit(" "), depth.cast("string"), F.lit("bit"), F.when(floating, F.lit(" float")).otherwise(F.lit(""))))


def bits_per_pixel(megabytes: Column) -> Column:
    """From megabytes (2^20) a second at 1920 x 1080 and 25 frames."""
    return megabytes * 1024.0 * 1024.0 * 8.0 / (1920.0 * 1080.0 * 25.0)

"""Frame packets: a header of 53 bytes, then slices of 17 bytes and their payload. Both ways are projections over
one binary column, so that a scan of headers reads no payload and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planeframe.functions import binary as B
from planeframe.operators import block

# The format's magic, its fields (name, bytes) in order, and status codes.
MAGIC = "TPIC"
HEADER = [
    ("header_size", 2), ("version_major", 1), ("version_minor", 1), ("flags", 2), ("profile", 1), ("pixel_format", 1), ("bit_depth", 1),
    ("alpha_mode", 1), ("alpha_bit_depth", 1), ("frame_type", 1), ("gop_id", 2), ("ref_distance", 1), ("coded_width", 2), ("coded_height", 2),
    ("visible_width", 2), ("visible_height", 2), ("plane_count", 1), ("qmatrix_id", 1), ("qp_base", 1), ("slice_count", 2), ("color_range", 1),
    ("color_primaries", 1), ("color_transfer", 1), ("color_matrix", 1), ("chroma_siting", 1), ("sar_num", 2), ("sar_den", 2),
    ("frame_packet_size", 4), ("reserved0", 4), ("header_crc32", 4),
]
SLICE = [("size", 4), ("plane", 1), ("block_y0", 2), ("block_h", 2), ("qp_delta_biased", 1), ("k1", 1), ("k2", 1), ("k3", 1), ("crc", 4)]
HEADER_SIZE, SLICE_SIZE = 53, 17
OK, CONCEALED, ARGUMENT, VERSION, PROFILE, FORMAT, MATRIX, ALPHA, LIMIT, MALFORMED, TRUNCATED, CHECKSUM, STATE, REFERENCE = (
    0, 1, -1, -3, -4, -5, -6, -7, -8, -9, -10, -11, -12, -17
)
MESSAGES = {
    0: "ok", 1: "concealed", -1: "invalid argument", -2: "out of memory", -3: "unsupported version", -4: "unsupported profile", -5: "unsupported pixel format",
    -6: "unsupported matrix", -7: "unsupported alpha mode", -8: "limit exceeded", -9: "malformed", -10: "truncated", -11: "checksum mismatch", -12: "state",
    -13: "cancelled", -14: "io", -15: "buffer too small", -16: "not implemented", -17: "reference invalid",
}
MOST_DIM, MOST_PACKET, MOST_SLICES = 8192, 1 << 28, 512


def message(status: Column) -> Column:
    """The name of a status code; 'unknown' for others."""
    out = F.lit("unknown")
    for code, text in MESSAGES.items():
        out = F.when(status == code, F.lit(text)).otherwise(out)
    return out


def header(content: Column) -> Column:
    """The header's fields as a struct; null where the bytes end."""
    return B.be_struct(content, HEADER, 4)


def geometry_errors(h: Column) -> list[tuple[Column, int]]:
    """Field rules of the plain intra generation by offset: (violation, status)."""
    g = lambda n: h[n]
    even = lambda n: (g(n) > MOST_DIM) | (g(n) % 8 != 0)
    minor = F.when(g("bit_depth") == 16, 6).when(g("pixel_format") == 3, 5).when(g("qp_base") >= 64, 4).when(g("pixel_format") == 2, 3).when(g("pixel_format") == 1, 2).when(g("bit_depth") == 12, 1).otherwise(0)
    depth = F.when(g("alpha_mode") == 0, g("alpha_bit_depth") == 0).when(g("alpha_mode") == 1, g("alpha_bit_depth") == 16).otherwise(g("alpha_bit_depth").isin(8, 10, 12))
    return [
        (g("header_size") != HEADER_SIZE, MALFORMED),
        (g("version_major") != 1, VERSION),
        (g("flags") > 1, MALFORMED),
        (g("frame_type") != 0, VERSION),
        ((g("gop_id") != 0) | (g("ref_distance") != 0), MALFORMED),
        (~g("profile").isin(3, 5, 6, 7), PROFILE),
        ((g("profile") == 7) != (g("pixel_format") == 3), MALFORMED),
        ((g("profile") == 7) & ((g("alpha_mode") != 0) | (g("qmatrix_id") != 0)), MALFORMED),
        (g("profile").isin(5, 6) & (g("pixel_format") == 0), MALFORMED),
        ((g("profile") == 6) & (g("bit_depth") != 12), MALFORMED),
        (g("pixel_format") > 3, FORMAT),
        (~g("bit_depth").isin(10, 12, 16), FORMAT),
        (g("version_minor") < minor, VERSION),
        (g("alpha_mode") > 2, ALPHA),
        (~depth, MALFORMED),
        (even("coded_width") | even("coded_height") | (g("coded_width") < g("visible_width")) | (g("coded_height") < g("visible_height")), LIMIT),
        ((g("visible_width") < 1) | (g("visible_height") < 1), LIMIT),
        (g("plane_count") != F.when(g("pixel_format") == 3, 4).otherwise(3) + F.when(g("alpha_mode") != 0, 1).otherwise(0), MALFORMED),
        ((g("qmatrix_id") > 3), MATRIX),
        (g("qp_base") > 95, MALFORMED),
        ((g("slice_count") < g("plane_count")) | (g("slice_count") > MOST_SLICES), LIMIT),
        (g("color_range") > 1, MALFORMED),
        (~g("color_primaries").isin(1, 6, 9, 12), MALFORMED),
        (~g("color_transfer").isin(1, 8, 13, 16, 18), MALFORMED),
        (F.when(g("pixel_format").isin(2, 3), g("color_matrix") != 0).otherwise(~g("color_matrix").isin(1, 5, 9)), MALFORMED),
        (g("chroma_siting") > 2, MALFORMED),
        ((g("sar_num") == 0) != (g("sar_den") == 0), MALFORMED),
        (g("frame_packet_size") > MOST_PACKET, LIMIT),
        (g("reserved0") != 0, MALFORMED),
    ]


def first_error(rules: list[tuple[Column, int]], otherwise: Column | None = None) -> Column:
    """The status of the first rule that is violated; 0 without one."""
    out = F.lit(0) if otherwise is None else otherwise
    for bad, status in reversed(rules):
        out = F.when(bad, F.lit(status)).otherwise(out)
    return out.cast("int")


def header_status(content: Column, h: Column) -> Column:
    """Size, magic, checksum, then the fields in order; the first failure counts."""
    rules = lambda h: first_error(
        [
            (F.coalesce(F.octet_length(content), F.lit(0)) < HEADER_SIZE, TRUNCATED),
            (F.substring(content, 1, 4) != F.lit(MAGIC).cast("binary"), MALFORMED),
            (F.crc32(B.piece(content, 0, 49)) != h["header_crc32"], CHECKSUM),
            *geometry_errors(h),
            (h["frame_packet_size"] != F.octet_length(content), MALFORMED),
        ]
    )
    return B.once(h, rules)


_SLICES = "array<struct<n:int,plane:bigint,block_y0:bigint,block_h:bigint,qp_delta_biased:bigint,k1:bigint,k2:bigint,k3:bigint,crc:bigint,off:bigint,size:bigint,ok:boolean>>"


def slices(content: Column, count: Column) -> Column:
    """The slices, each with the place and size of its payload and whether its checksum holds; fewer than count
    where a slice would reach over the end."""
    size = F.octet_length(content)

    def step(acc: Column, n: Column) -> Column:
        return B.once(B.be_struct(content, SLICE, acc["at"]), lambda f: following(acc, n, acc["at"], f))

    def following(acc: Column, n: Column, at: Column, f: Column) -> Column:
        inside = (at >= 0) & (at + SLICE_SIZE <= size) & (at + SLICE_SIZE + f["size"] <= size)
        off = at + SLICE_SIZE
        one = F.struct(
            n.alias("n"), *[f[x].alias(x) for x in ("plane", "block_y0", "block_h", "qp_delta_biased", "k1", "k2", "k3", "crc")], off.cast("bigint").alias("off"), f["size"].alias("size"),
            (F.crc32(B.piece(content, off, f["size"])) == f["crc"]).alias("ok"),
        )
        # a place below zero: the walk is over
        return F.when(inside, F.struct((off + f["size"]).cast("bigint").alias("at"), F.array_append(acc["out"], one).alias("out"))).otherwise(F.struct(F.lit(-1).cast("bigint").alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(HEADER_SIZE).cast("bigint").alias("at"), F.expr(f"CAST(array() AS {_SLICES})").alias("out"))
    numbers = F.when(count > 0, F.sequence(F.lit(0), F.least(count, F.lit(MOST_SLICES)).cast("int") - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.aggregate(numbers, start, step, lambda acc: acc["out"])


def parsed(df: DataFrame, content: str = "content") -> DataFrame:
    """df with header, status (of header and structure; slices with bad checksums leave it at CONCEALED) and slices."""
    df = block.held(df.withColumn("header", header(F.col(content))), "header", header(F.col(content)))
    df = block.held(df, "status", header_status(F.col(content), F.col("header")))
    empty = F.expr(f"CAST(array() AS {_SLICES})")
    df = block.held(df, "slices", F.when(F.col("status") == OK, slices(F.col(content), F.col("header.slice_count"))).otherwise(empty))
    whole = F.size("slices") == F.col("header.slice_count")
    bad = F.exists("slices", lambda s: ~s["ok"])
    return df.withColumn("status", F.when(F.col("status") != OK, F.col("status")).when(~whole, TRUNCATED).when(bad, CONCEALED).otherwise(OK).cast("int"))


def built(df: DataFrame, config: dict[str, Column | int], slices_: Column) -> DataFrame:
    """df with `content`: a packet of the header's fields (others are 0) and of slices
    (plane, block_y0, block_h, qp_delta_biased, k1, k2, k3, payload)."""
    body = F.transform(
        slices_,
        lambda s: F.concat(B.to_be_all([(F.octet_length(s["payload"]), 4), *[(s[n], w) for n, w in SLICE[1:-1]], (F.crc32(s["payload"]), 4)]), s["payload"]),
    )
    df = block.held(df, "_body", B.joined(body))
    value = {"header_size": HEADER_SIZE, "slice_count": F.size(slices_), "frame_packet_size": F.octet_length("_body") + HEADER_SIZE, **config}
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    front = F.concat(F.lit(MAGIC).cast("binary"), B.to_be_all([(lit(value.get(n, 0)), w) for n, w in HEADER[:-1]]))
    df = block.held(df, "_front", front)
    return df.withColumn("content", F.concat("_front", B.to_be(F.crc32("_front"), 4), "_body")).drop("_front", "_body")


def payloads(df: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """(by, n, plane, …, payload) of the slices of parsed() rows; payload null where the checksum fails."""
    each = df.select(*by, content, F.explode("slices").alias("s")).select(*by, content, "s.*")
    return each.withColumn("payload", F.when(F.col("ok"), B.piece(F.col(content), F.col("off"), F.col("size")))).drop(content)


def conceal_count(slices_: Column) -> Column:
    return F.size(F.filter(slices_, lambda s: ~s["ok"])).cast("bigint")


def byte_stats(slices_: Column) -> Column:
    """Payload and header bytes of colour and alpha slices."""
    total = lambda test, f: F.aggregate(F.filter(slices_, test), F.lit(0).cast("bigint"), lambda a, s: a + f(s))
    color, alpha = (lambda s: s["plane"] < 3), (lambda s: s["plane"] == 3)
    size, head = (lambda s: s["size"]), (lambda s: F.lit(SLICE_SIZE).cast("bigint"))
    return F.struct(total(color, size).alias("color_payload"), total(alpha, size).alias("alpha_payload"), total(color, head).alias("color_header"), total(alpha, head).alias("alpha_header"))


def neutral(plane: Column, depth: Column | int) -> Column:
    """What a damaged slice is filled with: the middle of the range, opaque for alpha."""
    return F.when(plane == 3, F.lit(65535)).otherwise(F.pow(F.lit(2.0), F.lit(depth) - 1 if isinstance(depth, int) else depth - 1).cast("bigint")).cast("bigint")

"""Image files: a preamble of 64 bytes, chunks, and a directory of 32 bytes a chunk. Reading and writing are
projections over one binary column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planeframe.functions import binary as B
from planeframe.operators import block
from planeframe.sources import packet as P

# Magic, layouts and status codes.
MAGIC = "TPIM"
PREAMBLE = [
    ("major", 2), ("minor", 2), ("preamble_size", 4), ("flags", 4), ("file_size", 8), ("directory_offset", 8), ("entry_size", 4), ("count", 4),
    ("primary", 4), ("compatibility", 4), ("header_crc32", 4), ("directory_crc32", 4), ("reserved", 8),
]
PREAMBLE_SIZE, ENTRY_SIZE, MOST_CHUNKS = 64, 32, 64
CRITICAL, OPTIONAL = 1, 2
CRITICAL_TYPES = ("IDSC", "PIXL")
LIMITS = {"PIXL": 1 << 28, "ICCP": 8 << 20, "OCIO": 4096, "XMP ": 16 << 20, "EXIF": 16 << 20, "THMB": 4 << 20, "HASH": 36, "TRWM": 256, "TMET": 1024, "IDSC": 128}
BAD_MAGIC, BAD_PREAMBLE, BAD_DIRECTORY, UNKNOWN_CRITICAL, CONFLICT, METADATA, LIMIT = -100, -101, -102, -103, -104, -105, -106


def _big(content: Column, at: int, n: int) -> Column:
    """As binary.be; of eight bytes the upper half must be small enough for a signed integer."""
    return B.be(content, at, n) if n < 8 else (B.be(content, at, 4) * (1 << 32) + B.be(content, at + 4, 4))


def preamble(content: Column) -> Column:
    out, at = [], 4
    for name, n in PREAMBLE:
        out.append(_big(content, at, n).alias(name))
        at += n
    return F.struct(*out)


def directory(content: Column, p: Column) -> Column:
    """The directory's entries: (n, fourcc, flags, off, size, crc, ok)."""

    def entry(i: Column) -> Column:
        at = p["directory_offset"] + i * ENTRY_SIZE
        big = lambda a: B.be(content, a, 4) * (1 << 32) + B.be(content, a + 4, 4)
        off, size, crc = big(at + 8), big(at + 16), B.be(content, at + 24, 4)
        return F.struct(
            i.alias("n"), B.piece(content, at, 4).cast("string").alias("fourcc"), B.be(content, at + 4, 4).alias("flags"), off.alias("off"), size.alias("size"), crc.alias("crc"),
            (F.crc32(B.piece(content, off, size)) == crc).alias("ok"),
        )

    return F.transform(F.sequence(F.lit(0), F.least(p["count"], F.lit(MOST_CHUNKS)).cast("int") - 1), entry)


def preamble_status(content: Column, p: Column) -> Column:
    zeroed = F.concat(B.piece(content, 0, 48), F.unhex(F.lit("00000000")), B.piece(content, 52, 12))
    size = F.octet_length(content)
    return P.first_error(
        [
            (size < PREAMBLE_SIZE, P.TRUNCATED),
            (F.substring(content, 1, 4) != F.lit(MAGIC).cast("binary"), BAD_MAGIC),
            (F.crc32(zeroed) != p["header_crc32"], BAD_PREAMBLE),
            (p["major"] != 1, P.VERSION),
            ((p["preamble_size"] != PREAMBLE_SIZE) | (p["flags"] != 0) | (p["file_size"] != size) | (p["entry_size"] != ENTRY_SIZE) | (p["primary"] != 0), BAD_PREAMBLE),
            ((p["count"] < 2) | (p["count"] > MOST_CHUNKS), LIMIT),
            ((p["directory_offset"] < PREAMBLE_SIZE) | (p["directory_offset"] + p["count"] * ENTRY_SIZE > size), BAD_DIRECTORY),
            (F.crc32(B.piece(content, p["directory_offset"], p["count"] * ENTRY_SIZE)) != p["directory_crc32"], BAD_PREAMBLE),
        ]
    )


def directory_status(entries: Column, p: Column) -> Column:
    """Order, bounds, overlaps, duplicates, unknown critical chunks, missing ones, and sizes, in this order."""
    ends = p["directory_offset"] + p["count"] * ENTRY_SIZE
    end = lambda e: e["off"] + e["size"]
    out_of = F.exists(entries, lambda e: (e["off"] < PREAMBLE_SIZE) | (end(e) > p["file_size"]) | ((e["off"] < ends) & (end(e) > p["directory_offset"])))
    pairs = F.zip_with(F.slice(entries, 1, F.greatest(F.size(entries) - 1, F.lit(0))), F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(0))), lambda a, b: b["off"] < end(a))
    critical = F.transform(F.filter(entries, lambda e: e["flags"].bitwiseAND(F.lit(CRITICAL)) != 0), lambda e: e["fourcc"])
    limit = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])
    return P.first_error(
        [
            (out_of | F.exists(pairs, lambda x: x), BAD_DIRECTORY),
            (F.size(F.array_distinct(critical)) < F.size(critical), BAD_DIRECTORY),
            (F.exists(critical, lambda t: ~t.isin(*CRITICAL_TYPES)), UNKNOWN_CRITICAL),
            (F.size(F.array_intersect(critical, F.array(*[F.lit(t) for t in CRITICAL_TYPES]))) < 2, BAD_DIRECTORY),
            (F.exists(entries, lambda e: e["size"] > F.coalesce(F.try_element_at(limit, e["fourcc"]), F.lit(16 << 20))), LIMIT),
            (F.exists(entries, lambda e: ~e["ok"]), P.CHECKSUM),
        ]
    )


def directory_rows(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, ok) of entries(by, n, fourcc, flags, off, size) as rows: neither overlaps nor two critical chunks of a kind."""
    w = Window.partitionBy(*by).orderBy("n")
    kind = Window.partitionBy(*by, "fourcc")
    critical = F.col("flags").bitwiseAND(F.lit(CRITICAL)) != 0
    marked = entries.withColumn("_over", F.coalesce(F.col("off") < F.lag(F.col("off") + F.col("size")).over(w), F.lit(False))).withColumn("_twice", critical & (F.sum(critical.cast("int")).over(kind) > 1))
    return marked.groupBy(*by).agg((~F.max(F.col("_over") | F.col("_twice"))).alias("ok"))


def parsed(df: DataFrame, content: str = "content") -> DataFrame:
    """df with preamble, status and chunks. Nothing but the preamble, the directory and checksums is looked at."""
    c = F.col(content)
    df = block.held(df, "preamble", preamble(c))
    df = df.withColumn("status", preamble_status(c, F.col("preamble")))
    kind = "array<struct<n:int,fourcc:string,flags:bigint,off:bigint,size:bigint,crc:bigint,ok:boolean>>"
    df = block.held(df, "chunks", F.when(F.col("status") == 0, directory(c, F.col("preamble")).cast(kind)).otherwise(F.expr(f"CAST(array() AS {kind})")))
    return df.withColumn("status", F.when(F.col("status") == 0, directory_status(F.col("chunks"), F.col("preamble"))).otherwise(F.col("status")))


def chunk(content: Column, chunks: Column, fourcc: str) -> Column:
    """The bytes of the first chunk of the kind; null without one."""
    found = F.get(F.filter(chunks, lambda e: e["fourcc"] == fourcc), F.lit(0))
    return F.when(found.isNotNull(), B.piece(content, found["off"], found["size"]))


def built(df: DataFrame, chunks: Column) -> DataFrame:
    """df with `content`: a file of chunks (fourcc, flags, data) in their order, the directory after the preamble."""
    df = block.held(df, "_c", chunks)
    n = F.size("_c")
    first = F.lit(PREAMBLE_SIZE) + n * ENTRY_SIZE
    before = lambda i: F.aggregate(F.slice("_c", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["data"]))
    entries = F.transform(
        "_c",
        lambda x, i: F.concat(
            x["fourcc"].cast("binary"), B.to_be(x["flags"], 4), B.to_be(first + before(i), 8), B.to_be(F.octet_length(x["data"]), 8), B.to_be(F.crc32(x["data"]), 4), F.unhex(F.lit("00000000"))
        ),
    )
    df = block.held(df, "_dir", B.joined(entries))
    df = block.held(df, "_data", B.joined(F.transform("_c", lambda x: x["data"])))
    value = {"major": F.lit(1), "preamble_size": F.lit(PREAMBLE_SIZE), "file_size": first + F.octet_length("_data"), "directory_offset": F.lit(PREAMBLE_SIZE), "entry_size": F.lit(ENTRY_SIZE), "count": n, "directory_crc32": F.crc32("_dir")}
    front = lambda crc: F.concat(F.lit(MAGIC).cast("binary"), *[B.to_be({**value, "header_crc32": crc}.get(name, F.lit(0)), w) for name, w in PREAMBLE])
    df = block.held(df, "_front", front(F.lit(0)))
    return df.withColumn("content", F.concat(front(F.crc32("_front")), "_dir", "_data")).drop("_c", "_dir", "_data", "_front")


# ---- descriptions -------------------------------------------------------------------------------------------


# The description's fields (name, bytes) after its name, in order; 128 bytes with zeros at the end.
DESCRIPTION = [
    ("major", 2), ("minor", 2), ("size", 4), ("flags", 4), ("display_x_min", 4), ("display_y_min", 4), ("display_x_max", 4), ("display_y_max", 4),
    ("data_x_min", 4), ("data_y_min", 4), ("data_x_max", 4), ("data_y_max", 4), ("orientation", 4), ("pixel_aspect_num", 4), ("pixel_aspect_den", 4),
    ("channel_model", 1), ("channel_count", 1), ("sample_kind", 1), ("valid_bit_depth", 1), ("container_bit_depth", 1), ("storage_layout", 1),
    ("subsampling", 1), ("chroma_siting", 1), ("alpha_presence", 1), ("alpha_mode", 1), ("alpha_bit_depth", 1), ("alpha_max_abs_err", 1), ("codec_id", 1),
    ("payload_major", 1), ("payload_minor", 1), ("image_profile", 1), ("codec_profile", 1), ("pixel_format", 1), ("color_primaries", 1), ("color_transfer", 1),
    ("color_matrix", 1), ("color_range", 1), ("iccp_ref", 1), ("ocio_ref", 1), ("payload_header_crc32", 4),
]
DESCRIPTION_SIZE = 128
_SIGNED = frozenset(n for n, _ in DESCRIPTION if n.startswith(("display_", "data_")))


def description_bytes(s: Column, names: list[str]) -> Column:
    """The 128 bytes of a description, from a struct with the given fields; others are 0."""
    value = {"major": F.lit(1), "size": F.lit(DESCRIPTION_SIZE), **{n: s[n] for n in names}}
    body = F.concat(F.lit("IDSC").cast("binary"), *[B.to_be(value.get(n, F.lit(0)), w) for n, w in DESCRIPTION])
    used = 4 + sum(w for _, w in DESCRIPTION)
    return F.concat(body, F.unhex(F.lit("00" * (DESCRIPTION_SIZE - used))))


def description(raw: Column) -> Column:
    """The fields of a description's bytes; null if they are not 128 or begin otherwise."""
    out, at = [], 4
    for name, n in DESCRIPTION:
        v = B.be(raw, at, n)
        out.append((F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v) if name in _SIGNED else v).alias(name))
        at += n
    return F.when((F.octet_length(raw) == DESCRIPTION_SIZE) & (B.piece(raw, 0, 4) == F.lit("IDSC").cast("binary")), F.struct(*out))


def with_packet(df: DataFrame, content: str = "content") -> DataFrame:
    """df with content: an image file around each packet, described by the packet's own header."""
    df = block.held(df, "_h", P.header(F.col(content)))
    df = block.held(df, "_s", described(F.col("_h")))
    names = [f.name for f in df.schema["_s"].dataType.fields]
    chunk = lambda t, d: F.struct(F.lit(t).alias("fourcc"), F.lit(CRITICAL).cast("bigint").alias("flags"), d.alias("data"))
    pixels = df.withColumnRenamed(content, "_packet")
    made = built(pixels, F.array(chunk("IDSC", description_bytes(F.col("_s"), names)), chunk("PIXL", F.col("_packet"))))
    return made.drop("_h", "_s", "_packet")


def packets_of(df: DataFrame, content: str = "content") -> DataFrame:
    """df with packet and status: the packet inside each file; the status is that of the file, then of the description,
    then of both against each other."""
    p = parsed(df, content)
    p = block.held(p, "packet", chunk(F.col(content), F.col("chunks"), "PIXL"))
    p = block.held(p, "_h", P.header(F.col("packet")))
    p = block.held(p, "_s", description(chunk(F.col(content), F.col("chunks"), "IDSC")))
    inside = P.first_error([(F.col("_s").isNull(), BAD_DIRECTORY), (description_status(F.col("_s")) != 0, BAD_DIRECTORY)], crosscheck(F.col("_s"), F.col("_h")))
    return p.withColumn("status", F.when(F.col("status") == 0, inside).otherwise(F.col("status"))).drop("_h", "_s", "preamble", "chunks")


def description_status(s: Column) -> Column:
    """Rules of an image description (a struct of its fields), the first violation counts."""
    return P.first_error(
        [
            (s["flags"] > 1, BAD_DIRECTORY),
            ((s["display_x_max"] < s["display_x_min"]) | (s["display_y_max"] < s["display_y_min"]), BAD_DIRECTORY),
            ((s["data_x_max"] < s["data_x_min"]) | (s["data_y_max"] < s["data_y_min"]), BAD_DIRECTORY),
            ((s["display_x_min"] > s["data_x_min"]) | (s["display_y_min"] > s["data_y_min"]) | (s["display_x_max"] < s["data_x_max"]) | (s["display_y_max"] < s["data_y_max"]), CONFLICT),
            (~s["orientation"].between(1, 8), BAD_DIRECTORY),
            ((s["pixel_aspect_num"] < 1) | (s["pixel_aspect_den"] < 1), BAD_DIRECTORY),
            (s["channel_model"] > 3, BAD_DIRECTORY),
            (~s["channel_count"].isin(3, 4), BAD_DIRECTORY),
            (s["sample_kind"] > 1, P.VERSION),
            (~s["valid_bit_depth"].isin(8, 10, 12, 16), BAD_DIRECTORY),
            (~s["container_bit_depth"].isin(10, 12, 16), BAD_DIRECTORY),
            (s["valid_bit_depth"] > s["container_bit_depth"], BAD_DIRECTORY),
            (s["storage_layout"] != 1, P.VERSION),
        ]
    )


def combination_ok(profile: Column, pixel_format: Column, depth: Column, codec_profile: Column) -> Column:
    """Whether an image profile goes with the pixel format, depth and codec profile."""
    return (
        F.when(profile == 0, (pixel_format == 0) & (codec_profile == 3) & depth.isin(10, 12))
        .when(profile == 1, (pixel_format == 2) & (depth == 10) & (codec_profile == 5))
        .when(profile == 2, (pixel_format == 2) & (depth == 12) & codec_profile.isin(5, 6))
        .when(profile == 3, (pixel_format == 3) & depth.isin(12, 16) & (codec_profile == 7))
        .when(profile == 4, (pixel_format == 2) & (depth == 16) & (codec_profile == 5))
        .otherwise(False)
    )


def crosscheck(s: Column, h: Column) -> Column:
    """An image description against the header of the packet inside: CONFLICT at the first difference."""
    same = lambda a, b: h[a] != s[b]
    unit = (h["sar_num"] == 0) & (h["sar_den"] == 0)
    rules = [
        (s["data_x_max"] - s["data_x_min"] + 1 != h["visible_width"]) | (s["data_y_max"] - s["data_y_min"] + 1 != h["visible_height"]),
        same("pixel_format", "pixel_format"),
        same("bit_depth", "valid_bit_depth"),
        same("profile", "codec_profile"),
        ~combination_ok(s["image_profile"], h["pixel_format"], h["bit_depth"], h["profile"]),
        same("alpha_mode", "alpha_mode") | same("alpha_bit_depth", "alpha_bit_depth"),
        (s["alpha_presence"] != 0) & (s["alpha_presence"] != F.when(h["flags"].bitwiseAND(F.lit(1)) != 0, 2).otherwise(1)),
        same("color_range", "color_range") | same("color_primaries", "color_primaries") | same("color_transfer", "color_transfer") | same("color_matrix", "color_matrix"),
        same("chroma_siting", "chroma_siting"),
        (F.when(unit, 1).otherwise(h["sar_num"]) != s["pixel_aspect_num"]) | (F.when(unit, 1).otherwise(h["sar_den"]) != s["pixel_aspect_den"]),
    ]
    return P.first_error([(r, CONFLICT) for r in rules])


def described(h: Column) -> Column:
    """The description of an image that follows from its packet's header: windows as large as the picture, square pixels
    where the header names none, the image profile that goes with the packet's. A null profile goes with no image."""
    g = lambda n: h[n].cast("bigint")
    unit = (h["sar_num"] == 0) & (h["sar_den"] == 0)
    lit = lambda v: F.lit(v).cast("bigint")
    profile = F.lit(None).cast("bigint")
    for p in range(5):
        profile = F.when(combination_ok(lit(p), g("pixel_format"), g("bit_depth"), g("profile")), lit(p)).otherwise(profile)
    alpha = h["alpha_mode"] != 0
    fields = {
        "flags": lit(0), "display_x_min": lit(0), "display_y_min": lit(0), "display_x_max": g("visible_width") - 1, "display_y_max": g("visible_height") - 1,
        "data_x_min": lit(0), "data_y_min": lit(0), "data_x_max": g("visible_width") - 1, "data_y_max": g("visible_height") - 1, "orientation": lit(1),
        "pixel_aspect_num": F.when(unit, lit(1)).otherwise(g("sar_num")), "pixel_aspect_den": F.when(unit, lit(1)).otherwise(g("sar_den")),
        "channel_model": F.when(h["pixel_format"] == 3, lit(3)).when(h["pixel_format"] == 2, lit(0)).otherwise(lit(1)), "channel_count": F.when(alpha, lit(4)).otherwise(lit(3)),
        "sample_kind": F.when(profile == 4, lit(1)).otherwise(lit(0)), "valid_bit_depth": g("bit_depth"), "container_bit_depth": g("bit_depth"), "storage_layout": lit(1),
        "alpha_presence": F.when(~alpha, lit(0)).when(h["flags"].bitwiseAND(F.lit(1)) != 0, lit(2)).otherwise(lit(1)), "image_profile": profile, "codec_profile": g("profile"),
        **{n: g(n) for n in ("alpha_mode", "alpha_bit_depth", "pixel_format", "color_primaries", "color_transfer", "color_matrix", "color_range", "chroma_siting")},
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def colour_name_ok(raw: Column) -> Column:
    """A colour space's name: valid UTF-8 of 1 to 4096 bytes without control characters."""
    return F.octet_length(raw).between(1, 4096) & F.is_valid_utf8(raw.cast("string")) & ~F.coalesce(F.make_valid_utf8(raw.cast("string")).rlike(r"[\x00-\x1F\x7F]"), F.lit(False))


def colour_profile_ok(raw: Column) -> Column:
    """An ICC profile: at least a header, its own size in front, 'acsp' at 36, and a colour space that images may have."""
    return (F.octet_length(raw) >= 132) & (B.be(raw, 0, 4) == F.octet_length(raw)) & (B.piece(raw, 36, 4) == F.lit("acsp").cast("binary")) & B.piece(raw, 16, 4).isin(*[F.lit(x).cast("binary") for x in ("RGB ", "GRAY", "CMYK")])

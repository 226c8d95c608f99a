"""Queries over rules: combinations made from the driver's keys, and the status that each gets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from planeframe.functions import scalar
from planeframe.operators import control, rules
from planeframe.queries import _FR, frames, query, table
from planeframe.sources import image, movie

_SUPPORT = "CASE WHEN p NOT IN (3, 5, 6, 7) THEN -4 WHEN f > 3 OR d NOT IN (10, 12, 16) THEN -5 WHEN (p = 7) <> (f = 3) THEN -5 WHEN p = 7 AND (d NOT IN (12, 16) OR a <> 0) THEN -5 WHEN p IN (5, 6) AND f = 0 THEN -5 WHEN p = 6 AND d <> 12 THEN -5 WHEN a > 2 THEN -7 ELSE 0 END"
_KEYS = "k AS (SELECT o_orderkey, o_orderkey % 8 AS p, o_orderkey // 8 % 5 AS f, [8, 10, 12, 16][CAST(o_orderkey // 40 % 4 AS INTEGER) + 1] AS d, o_orderkey // 160 % 4 AS a FROM orders)"


def _keys(spark, sf_dir):
    k = F.col("o_orderkey")
    depth = F.get(F.array(*[F.lit(x) for x in (8, 10, 12, 16)]), (F.floor(k / 40) % 4).cast("int")).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", (k % 8).alias("profile"), (F.floor(k / 8) % 5).alias("pixel_format"), depth.alias("bit_depth"), (F.floor(k / 160) % 4).alias("alpha_mode"))


@query(f"WITH {_KEYS} SELECT o_orderkey, CAST({_SUPPORT} AS INTEGER) AS status, {_SUPPORT} = 0 AS known FROM k")
def support_query(spark, sf_dir):
    """Status of a combination, and whether the capability table has it."""
    k = _keys(spark, sf_dir)
    names = ["profile", "pixel_format", "bit_depth", "alpha_mode"]
    known = rules.capabilities(k).withColumn("known", F.lit(True))
    both = k.join(F.broadcast(known), names, "left")  # some dozens of rows
    return both.select("o_orderkey", rules.support_status(*[F.col(n) for n in names]).alias("status"), F.coalesce("known", F.lit(False)).alias("known"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 13 AS c, o_orderkey // 13 % 3 AS x3, o_orderkey // 39 % 5 AS x5, o_orderkey // 7 % 4 AS a, o_orderkey % 97 AS qp, [8, 10, 12, 16][CAST(o_orderkey // 5 % 4 AS INTEGER) + 1] AS d FROM orders)
SELECT o_orderkey, CAST(CASE WHEN qp > 95 THEN -1 WHEN c > 11 OR c BETWEEN 2 AND 7 THEN -1 WHEN c < 9 AND x3 <> 0 THEN -1 WHEN c < 10 AND c <> 8 AND x5 <> 0 THEN -1 WHEN c = 8 AND x5 <> 0 AND (x5 > 3 OR d <> 10) THEN -1 WHEN c >= 10 AND (x3 > 1 OR x5 <> x3) THEN -1
WHEN a > 2 THEN -1 WHEN a = 1 AND d <> 16 THEN -1 WHEN a = 2 AND d NOT IN (8, 10, 12) THEN -1 WHEN d >= 13 AND c NOT IN (8, 9) THEN -1 ELSE 0 END AS INTEGER) AS status FROM k""")
def config_check(spark, sf_dir):
    """Frame configurations with coding, extra fields, alpha and depth from an order's key."""
    k = F.col("o_orderkey")
    depth = F.get(F.array(*[F.lit(x) for x in (8, 10, 12, 16)]), (F.floor(k / 5) % 4).cast("int"))
    zero = F.lit(0)
    c = F.struct(
        F.lit(60).alias("width"), F.lit(20).alias("height"), (k % 97).alias("qp"), (k % 13).alias("coding"), zero.alias("aq"), zero.alias("rdo"), (F.floor(k / 13) % 3).alias("x3"), zero.alias("x4"),
        (F.floor(k / 39) % 5).alias("x5"), zero.alias("x6"), zero.alias("x7"), F.lit(3).alias("profile"), zero.alias("pixel_format"), depth.alias("bit_depth"), (F.floor(k / 7) % 4).alias("alpha_mode"),
        depth.alias("alpha_bit_depth"), zero.alias("qp_delta_chroma"),
    )
    return table(spark, sf_dir, "orders").withColumn("c", c).select("o_orderkey", rules.config_status(F.col("c")).alias("status"))


_REQ = "k AS (SELECT o_orderkey, o_orderkey % 5 AS m, o_orderkey // 5 % 6 AS s, CASE WHEN o_orderkey // 30 % 2 = 0 THEN 0 ELSE 640 END AS w, CASE WHEN o_orderkey // 60 % 2 = 0 THEN 0 ELSE 360 END AS h, o_orderkey % 9000 + 1 AS vw, o_orderkey % 5000 + 1 AS vh, o_orderkey % 3 AS fl FROM orders)"
_BAD = "m > 3 OR fl > 1 OR (w = 0) <> (h = 0) OR (m = 0 AND (s <> 0 OR w <> 0)) OR (m = 1 AND (s <> 0 OR w = 0)) OR (m = 2 AND (s > 4 OR w <> 0)) OR (m = 3 AND s <> 0)"


@query(f"""WITH {_REQ}, v AS (SELECT *, {_BAD} AS bad, greatest(vw, vh) AS e FROM k),
a AS (SELECT *, CASE WHEN m = 2 THEN s WHEN m = 3 THEN CASE WHEN e <= 2048 THEN 0 WHEN (e + 1) // 2 <= 2048 THEN 1 WHEN (e + 2) // 3 <= 2048 THEN 2 WHEN (e + 3) // 4 <= 2048 THEN 3 ELSE 4 END ELSE 0 END AS lv, m = 1 OR (m = 3 AND w > 0) AS tg FROM v),
d AS (SELECT *, [1, 2, 3, 4, 8][CAST(lv AS INTEGER) + 1] AS d FROM a)
SELECT o_orderkey, CAST(CASE WHEN bad THEN -1 ELSE 0 END AS INTEGER) AS status, CAST(CASE WHEN bad THEN NULL WHEN tg THEN w ELSE (vw + d - 1) // d END AS BIGINT) AS width, CAST(CASE WHEN bad THEN NULL WHEN tg THEN h ELSE (vh + d - 1) // d END AS BIGINT) AS height,
CAST(CASE WHEN bad THEN NULL WHEN tg THEN 63 ELSE [63, 24, 16, 10, 4][CAST(lv AS INTEGER) + 1] END AS BIGINT) AS coefficient_limit, CASE WHEN NOT bad THEN fl = 1 END AS drop_alpha FROM d""")
def decode_requests(spark, sf_dir):
    """Whether a decode request makes sense, and what it then means for its frame."""
    k = F.col("o_orderkey")
    at = lambda d, m: F.floor(k / d) % m
    r = table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 5).alias("m"), at(5, 6).alias("s"), F.when(at(30, 2) == 0, 0).otherwise(640).alias("w"), F.when(at(60, 2) == 0, 0).otherwise(360).alias("h"), (k % 3).alias("fl"),
        F.struct((k % 9000 + 1).alias("visible_width"), (k % 5000 + 1).alias("visible_height"), F.lit(1).alias("alpha_mode")).alias("frame"),
    )
    status = rules.request_status(F.col("m"), F.lit(0), F.lit(0), F.col("fl"), F.col("s"), F.col("w"), F.col("h"))
    plan = F.when(status == 0, rules.request_plan(F.col("frame"), F.col("m"), F.col("s"), F.col("w"), F.col("h"), F.col("fl")))
    return r.select("o_orderkey", status.alias("status"), plan.alias("p")).select("o_orderkey", "status", "p.*")


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 26 AS hh, o_orderkey // 3 % 61 AS mm, o_orderkey // 7 % 4 AS ss, o_orderkey // 11 % 33 AS ff, [24, 25, 29, 30, 60][CAST(o_orderkey % 5 AS INTEGER) + 1] AS fps, o_orderkey // 2 % 2 AS df FROM orders)
SELECT o_orderkey, CAST(CASE WHEN fps NOT IN (24, 25, 30, 48, 50, 60) OR (df <> 0 AND fps NOT IN (30, 60)) OR hh >= 24 OR mm >= 60 OR ff >= fps OR (df <> 0 AND ss = 0 AND mm % 10 <> 0 AND ff < CASE WHEN fps = 60 THEN 4 ELSE 2 END) THEN -1 ELSE 0 END AS INTEGER) AS status FROM k""")
def timecode_check(spark, sf_dir):
    k = F.col("o_orderkey")
    at = lambda d, m: F.floor(k / d) % m
    fps = F.get(F.array(*[F.lit(x) for x in (24, 25, 29, 30, 60)]), (k % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", movie.timecode_status(k % 26, at(3, 61), at(7, 4), at(11, 33), fps, at(2, 2)).alias("status"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 4 AS c, [44100, 48000, 22050, 96000][CAST(o_orderkey // 4 % 4 AS INTEGER) + 1] AS r, [1, 2, 6, 8, 3][CAST(o_orderkey // 16 % 5 AS INTEGER) + 1] AS ch, o_orderkey // 16 % 5 + 1 AS l, [0, 16, 24, 32][CAST(o_orderkey // 80 % 4 AS INTEGER) + 1] AS b, o_orderkey // 320 % 3 AS f FROM orders)
SELECT o_orderkey, CAST(CASE WHEN c IN (1, 2) AND r <> 22050 AND ch <> 3 AND f <= 1 AND (f = 0 OR (c = 1 AND b = 32)) AND CASE WHEN c = 1 THEN b > 0 ELSE b <= 16 END THEN 0 ELSE -1 END AS INTEGER) AS status FROM k""")
def audio_check(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda d, v: F.get(F.array(*[F.lit(x) for x in v]), (F.floor(k / d) % len(v)).cast("int"))
    status = movie.audio_status(k % 4, pick(4, (44100, 48000, 22050, 96000)), pick(16, (1, 2, 6, 8, 3)), F.floor(k / 16) % 5 + 1, pick(80, (0, 16, 24, 32)), F.floor(k / 320) % 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 9000 AS e, o_orderkey // 3 % 3 AS r, o_orderkey // 9 % 3 AS st, o_orderkey // 27 % 2 = 0 AS w, o_orderkey // 54 % 2 = 0 AS z, o_orderkey // 108 % 2 = 0 AS sp, o_orderkey % 11 AS a, o_orderkey % 7 AS b FROM orders)
SELECT o_orderkey, CAST(CASE WHEN e <= 4096 OR r = 1 OR st = 0 OR NOT w OR (st = 2 AND NOT (z AND sp)) OR (r = 2 AND (a = 0 OR b = 0 OR a > b)) THEN 1 ELSE r END AS INTEGER) AS selected,
CASE WHEN e <= 4096 OR r = 1 THEN 0 WHEN st = 0 THEN 1 WHEN NOT w THEN 2 WHEN st = 2 AND NOT (z AND sp) THEN 3 WHEN r = 2 AND (a = 0 OR b = 0 OR a > b) THEN 4 ELSE 0 END AS fallback FROM k""")
def base_policies(spark, sf_dir):
    """Which layer layout a frame gets, and why another one than was asked for."""
    k = F.col("o_orderkey")
    at = lambda d, m: F.floor(k / d) % m
    p = control.base_policy(k % 9000, F.lit(2048), at(3, 3), at(9, 3), at(27, 2) == 0, at(54, 2) == 0, at(108, 2) == 0, k % 11, k % 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.*")


_FMT = "n AS (SELECT p_partkey, ['yuv', 'yuva', 'gbr', 'gray'][CAST(p_partkey % 4 AS INTEGER) + 1] || CASE WHEN p_partkey % 4 < 2 THEN ['422p', '444p'][CAST(p_partkey // 4 % 2 AS INTEGER) + 1] ELSE 'p' END || [10, 12, 16][CAST(p_partkey // 8 % 3 AS INTEGER) + 1] || CASE WHEN p_partkey // 24 % 2 = 1 THEN 'a8' ELSE '' END AS name FROM part)"


@query(f"WITH {_FMT} SELECT p_partkey, name, CAST(CASE p_partkey % 4 WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE p_partkey // 4 % 2 END AS INTEGER) AS pixel_format, CAST(CASE WHEN p_partkey % 4 < 3 THEN [10, 12, 16][CAST(p_partkey // 8 % 3 AS INTEGER) + 1] END AS INTEGER) AS bit_depth, CAST(CASE WHEN p_partkey % 4 < 3 AND p_partkey // 24 % 2 = 1 THEN 8 END AS INTEGER) AS alpha_depth FROM n")
def pixel_formats(spark, sf_dir):
    """Names of pixel formats taken apart."""
    k = F.col("p_partkey")
    pick = lambda d, v: F.get(F.array(*[F.lit(x) for x in v]), (F.floor(k / d) % len(v)).cast("int"))
    name = F.concat(pick(1, ("yuv", "yuva", "gbr", "gray")), F.when(k % 4 < 2, pick(4, ("422p", "444p"))).otherwise("p"), pick(8, (10, 12, 16)).cast("string"), F.when(F.floor(k / 24) % 2 == 1, "a8").otherwise(""))
    named = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return named.select("p_partkey", "name", rules.pixel_format_of(F.col("name")).alias("f")).select("p_partkey", "name", "f.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 BETWEEN 1 AND 4 THEN ['Low', 'Medium', 'High', 'Ultra'][CAST(p_partkey % 6 AS INTEGER)] || ' ' || [10, 16][CAST(p_partkey // 6 % 2 AS INTEGER) + 1] || 'bit' || CASE WHEN p_partkey // 12 % 2 = 1 THEN ' float' ELSE '' END END AS label, CAST(greatest(1, round_even(CAST(p_size AS DOUBLE) * 1024.0 * 1024.0 * 8.0 / (1920.0 * 1080.0 * 25.0) * 640 * 360 / 8, 0)) AS BIGINT) AS bytes FROM part")
def tier_labels(spark, sf_dir):
    """Display names of image tiers, and the bytes of a 640 x 360 frame at p_size megabytes a second."""
    k = F.col("p_partkey")
    label = rules.tier_label(k % 6, F.when(F.floor(k / 6) % 2 == 0, 10).otherwise(16), F.floor(k / 12) % 2 == 1)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), scalar.bytes_for(rules.bits_per_pixel(F.col("p_size").cast("double")), F.lit(640), F.lit(360)).alias("bytes"))


@query("""WITH k AS (SELECT o_orderkey AS o, o_orderkey % 4 AS dx, o_orderkey % 10 AS ori, o_orderkey % 5 AS cm, o_orderkey // 5 % 3 AS sk, [8, 10, 12, 16][CAST(o_orderkey // 15 % 4 AS INTEGER) + 1] AS v, [10, 12, 16][CAST(o_orderkey // 60 % 3 AS INTEGER) + 1] AS c FROM orders)
SELECT o AS o_orderkey, CAST(CASE WHEN dx = 3 THEN -104 WHEN ori = 0 OR ori = 9 THEN -102 WHEN cm > 3 THEN -102 WHEN sk > 1 THEN -3 WHEN v > c THEN -102 ELSE 0 END AS INTEGER) AS status,
CAST(CASE WHEN dx <> 0 THEN -104 WHEN v <> 10 THEN -104 WHEN o % 7 <> 0 THEN -104 ELSE 0 END AS INTEGER) AS inside FROM k""")
def image_descriptions(spark, sf_dir):
    """Descriptions of images: the first rule that each breaks, and whether the packet inside is as it says."""
    k = F.col("o_orderkey")
    at = lambda d, m: F.floor(k / d) % m
    pick = lambda d, v: F.get(F.array(*[F.lit(x) for x in v]), (F.floor(k / d) % len(v)).cast("int"))
    fixed = {"flags": 0, "display_x_min": 0, "display_y_min": 0, "display_x_max": 61, "display_y_max": 19, "data_x_min": 0, "data_y_min": 0, "data_y_max": 19, "pixel_aspect_num": 1, "pixel_aspect_den": 1, "channel_count": 3, "storage_layout": 1, "codec_profile": 3, "alpha_presence": 0, "alpha_mode": 0, "alpha_bit_depth": 0, "color_range": 1, "color_primaries": 1, "color_transfer": 1, "color_matrix": 1, "chroma_siting": 0, "pixel_format": 0}
    s = F.struct(*[F.lit(v).alias(n) for n, v in fixed.items()], (k % 4 + 59).alias("data_x_max"), (k % 10).alias("orientation"), (k % 5).alias("channel_model"), at(5, 3).alias("sample_kind"), pick(15, (8, 10, 12, 16)).alias("valid_bit_depth"), pick(60, (10, 12, 16)).alias("container_bit_depth"), F.when(k % 7 == 0, 0).otherwise(1).alias("image_profile"))
    h = F.struct(*[F.lit(v).alias(n) for n, v in (("visible_width", 60), ("visible_height", 20), ("pixel_format", 0), ("bit_depth", 10), ("profile", 3), ("alpha_mode", 0), ("alpha_bit_depth", 0), ("flags", 0), ("color_range", 1), ("color_primaries", 1), ("color_transfer", 1), ("color_matrix", 1), ("chroma_siting", 0), ("sar_num", 0), ("sar_den", 0))])
    o = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"), h.alias("h"))
    return o.select("o_orderkey", image.description_status(F.col("s")).alias("status"), image.crosscheck(F.col("s"), F.col("h")).alias("inside"))


@query("""WITH k AS (SELECT o_orderkey AS o, o_orderkey % 3 AS pf, [10, 12, 16][CAST(o_orderkey // 3 % 3 AS INTEGER) + 1] AS d, [3, 5, 6][CAST(o_orderkey // 9 % 3 AS INTEGER) + 1] AS p FROM orders),
i AS (SELECT *, CASE WHEN pf = 0 AND p = 3 AND d IN (10, 12) THEN 0 WHEN pf = 2 AND d = 10 AND p = 5 THEN 1 WHEN pf = 2 AND d = 12 AND p IN (5, 6) THEN 2 WHEN pf = 2 AND d = 16 AND p = 5 THEN 4 END AS ip FROM k)
SELECT o AS o_orderkey, CAST(ip AS BIGINT) AS image_profile, CASE WHEN ip IS NOT NULL THEN 0 END AS inside, CASE WHEN ip IS NOT NULL THEN 0 END AS status FROM i""")
def image_derive(spark, sf_dir):
    """Descriptions made from packet headers: they keep all rules and agree with the header they come from."""
    k = F.col("o_orderkey")
    pick = lambda d, v: F.get(F.array(*[F.lit(x) for x in v]), (F.floor(k / d) % len(v)).cast("int"))
    fixed = {"visible_width": 60, "visible_height": 20, "alpha_mode": 0, "alpha_bit_depth": 0, "flags": 0, "color_range": 1, "color_primaries": 1, "color_transfer": 1, "color_matrix": 1, "chroma_siting": 0, "sar_num": 0, "sar_den": 0}
    h = F.struct(*[F.lit(v).alias(n) for n, v in fixed.items()], (k % 3).alias("pixel_format"), pick(3, (10, 12, 16)).alias("bit_depth"), pick(9, (3, 5, 6)).alias("profile"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", h.alias("h")).withColumn("s", image.described(F.col("h")))
    made = F.col("s.image_profile").isNotNull()
    return o.select("o_orderkey", "s.image_profile", F.when(made, image.crosscheck(F.col("s"), F.col("h"))).alias("inside"), F.when(made, image.description_status(F.col("s"))).alias("status"))


@query("SELECT doc_id, octet_length(encode(source)) BETWEEN 1 AND 4096 AS name_ok, octet_length(encode(text)) BETWEEN 1 AND 4096 AND NOT regexp_matches(text, '[\\x00-\\x1F\\x7F]') AS text_ok, false AS profile_ok FROM documents")
def metadata_check(spark, sf_dir):
    """Whether sources and texts may be names of colour spaces, and texts colour profiles."""
    raw = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", image.colour_name_ok(raw("source")).alias("name_ok"), image.colour_name_ok(raw("text")).alias("text_ok"), image.colour_profile_ok(raw("text")).alias("profile_ok"))


@query(f"""WITH {_FR}, k AS (SELECT user_id, event_id, size, sum(size) OVER w AS spent, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(greatest(1, CASE WHEN (total * 60 - spent) * 97 < 0 THEN -(((spent - total * 60) * 97 // 100) // greatest(1, total - n)) ELSE ((total * 60 - spent) * 97 // 100) // greatest(1, total - n) END) AS BIGINT) AS target FROM k""")
def budget_targets(spark, sf_dir):
    """Budget mode: the next frame's bytes, when 60 a frame are to be spent in all."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = frames(spark, sf_dir).select("user_id", "event_id", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("spent"), F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy("user_id")).alias("total"))
    return f.select("user_id", "event_id", control.frame_target(F.col("total") * 60, F.col("spent"), F.col("n"), F.col("total")).alias("target"))


@query("""WITH f AS (SELECT l_orderkey, CAST(sum(CAST(floor(l_tax * l_extendedprice) AS BIGINT)) AS BIGINT) AS alpha, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS color, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS err FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey % 100 AS movie, count(*) AS frames, CAST(sum(alpha) AS BIGINT) AS alpha, CAST(sum(color) AS BIGINT) AS color, max(err) AS max_error, CAST(least((sum(alpha) * 20000 + sum(color)) // (2 * sum(color)), 65535) AS BIGINT) AS bp, count(*) FILTER (alpha * 100 > color * 4) AS over FROM f GROUP BY l_orderkey % 100""")
def alpha_totals(spark, sf_dir):
    """A movie's alpha budget: bytes, the largest error, the share in basis points, and frames beyond it."""
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy("l_orderkey").agg(F.sum(F.floor(F.col("l_tax") * F.col("l_extendedprice"))).alias("alpha"), F.sum(F.floor("l_extendedprice")).alias("color"), F.max(F.col("l_quantity").cast("bigint")).alias("err"))
    sums = f.groupBy((F.col("l_orderkey") % 100).alias("movie")).agg(F.count("*").alias("frames"), F.sum("alpha").alias("alpha"), F.sum("color").alias("color"), F.max("err").alias("max_error"), F.count_if(F.col("alpha") * 100 > F.col("color") * 4).alias("over"))
    return sums.withColumn("bp", control.basis_points(F.col("alpha"), F.col("color")))


@query(f"""WITH {_FR}, s AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM fr) SELECT coalesce(p, '-') AS prev, event_type, count(*) AS n FROM s GROUP BY ALL""")
def symbol_pairs(spark, sf_dir):
    """The joint histogram of a symbol and the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return frames(spark, sf_dir).select(F.coalesce(F.lag("event_type").over(w), F.lit("-")).alias("prev"), "event_type").groupBy("prev", "event_type").agg(F.count("*").alias("n"))


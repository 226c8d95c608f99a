"""Queries over packets, movies and image files, each written by the engine from the driver's tables and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planeframe.functions import scalar
from planeframe.operators import rules
from planeframe.queries import _FR, frames, query, table
from planeframe.sources import image, movie, packet

#: A plain configuration: 4:2:2 of 10 bits, 64 x 24.
CONFIG = {
    "version_major": 1, "profile": 3, "bit_depth": 10, "coded_width": 64, "coded_height": 24, "visible_width": 60, "visible_height": 20, "plane_count": 3,
    "qp_base": 40, "color_range": 1, "color_primaries": 1, "color_transfer": 1, "color_matrix": 1,
}


def page_packets(spark, sf_dir) -> DataFrame:
    """page_id, html, content: each page's bytes in three slices, a third each. Of every seventh page one byte of the
    second slice is flipped, every eleventh packet is cut off within its last slice, of every thirteenth a header
    byte is flipped."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("html"))
    n = F.octet_length("html")
    third = F.floor(n / 3).cast("int")
    cuts = [(F.lit(1), third), (third + 1, third), (third * 2 + 1, n - third * 2)]
    lit = lambda v: F.lit(v).cast("bigint")
    slices = F.array(*[F.struct(lit(i).alias("plane"), lit(0).alias("block_y0"), lit(3).alias("block_h"), lit(64).alias("qp_delta_biased"), lit(1).alias("k1"), lit(2).alias("k2"), lit(3).alias("k3"), F.substring("html", a, w).alias("payload")) for i, (a, w) in enumerate(cuts)])
    made = packet.built(p.withColumn("third", third), CONFIG, slices)

    def flipped(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring("content", at.cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        return F.concat(F.substring("content", F.lit(1), at.cast("int")), F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(1))), 2, "0")), F.substring("content", at.cast("int") + 2, F.octet_length("content")))

    inside = F.lit(packet.HEADER_SIZE + 2 * packet.SLICE_SIZE) + F.col("third")
    damaged = (
        F.when(F.col("page_id") % 13 == 0, flipped(F.lit(20)))
        .when(F.col("page_id") % 11 == 0, F.substring("content", F.lit(1), F.octet_length("content") - 5))
        .when(F.col("page_id") % 7 == 0, flipped(inside))
        .otherwise(F.col("content"))
    )
    return made.withColumn("content", damaged)


_STATUS = "CASE WHEN page_id % 13 = 0 THEN -11 WHEN page_id % 11 = 0 THEN -9 WHEN page_id % 7 = 0 THEN 1 ELSE 0 END"
_PG = "p AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages)"


@query(f"WITH {_PG} SELECT page_id, CAST({_STATUS} AS INTEGER) AS status, CASE {_STATUS} WHEN 0 THEN 'ok' WHEN 1 THEN 'concealed' WHEN -9 THEN 'malformed' ELSE 'checksum mismatch' END AS message, CAST(CASE WHEN {_STATUS} >= 0 THEN 3 ELSE 0 END AS BIGINT) AS slices, CAST(CASE WHEN {_STATUS} = 1 THEN 1 ELSE 0 END AS BIGINT) AS concealed, CAST(CASE WHEN {_STATUS} >= 0 THEN n ELSE 0 END AS BIGINT) AS payload, CAST(CASE WHEN {_STATUS} >= 0 THEN 51 ELSE 0 END AS BIGINT) AS headers FROM p")
def packet_scan(spark, sf_dir):
    """Status of each packet, how many slices are damaged, and its bytes by kind."""
    s = packet.parsed(page_packets(spark, sf_dir))
    b = packet.byte_stats(F.col("slices"))
    return s.select("page_id", "status", packet.message(F.col("status")).alias("message"), F.size("slices").cast("bigint").alias("slices"), packet.conceal_count(F.col("slices")).alias("concealed"), b["color_payload"].alias("payload"), b["color_header"].alias("headers"))


@query(f"""WITH {_PG}, s AS (SELECT page_id, n, n // 3 AS t, unnest([0, 1, 2]) AS plane FROM p WHERE {_STATUS} >= 0)
SELECT page_id, CAST(plane AS BIGINT) AS plane, CAST(53 + 17 * (plane + 1) + plane * t AS BIGINT) AS off, CAST(CASE WHEN plane < 2 THEN t ELSE n - 2 * t END AS BIGINT) AS size, NOT (page_id % 7 = 0 AND plane = 1) AS ok FROM s""")
def packet_slices(spark, sf_dir):
    """Place and checksum of every slice of the packets that can be read."""
    s = packet.parsed(page_packets(spark, sf_dir)).select("page_id", F.explode("slices").alias("s"))
    return s.select("page_id", "s.plane", "s.off", "s.size", "s.ok")


@query(f"""WITH p AS (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages), s AS (SELECT page_id, h, n, n // 3 AS t, unnest([0, 1, 2]) AS plane FROM p WHERE {_STATUS} >= 0)
SELECT page_id, CAST(plane AS BIGINT) AS plane, CASE WHEN page_id % 7 = 0 AND plane = 1 THEN NULL ELSE substr(h, 2 * plane * t + 1, 2 * CASE WHEN plane < 2 THEN t ELSE n - 2 * t END) END AS payload, CAST(CASE WHEN page_id % 7 = 0 AND plane = 1 THEN 512 END AS BIGINT) AS filled FROM s""")
def packet_payloads(spark, sf_dir):
    """The bytes of every whole slice, and what a damaged one is filled with."""
    s = packet.payloads(packet.parsed(page_packets(spark, sf_dir)), ["page_id"])
    return s.select("page_id", "plane", F.hex("payload").alias("payload"), F.when(F.col("payload").isNull(), packet.neutral(F.col("plane"), 10)).alias("filled"))


#: Fields that the header query sets from an order's key: name, modulus, SQL.
_VARIED = {"version_major": 3, "flags": 4, "profile": 9, "pixel_format": 5, "bit_depth": 17, "alpha_mode": 4, "qmatrix_id": 6, "qp_base": 101, "chroma_siting": 4}


def varied(key: Column) -> dict[str, Column]:
    """One field in turn takes a value of its own; the others stay as in CONFIG."""
    names, out = list(_VARIED), {}
    for i, n in enumerate(names):
        out[n] = F.when(key % len(names) == i, F.floor(key / len(names)) % _VARIED[n]).otherwise(F.lit(CONFIG.get(n, 0))).cast("bigint")
    return out


def _varied_sql() -> str:
    return ", ".join(f"CASE WHEN k % {len(_VARIED)} = {i} THEN (k // {len(_VARIED)}) % {m} ELSE {CONFIG.get(n, 0)} END AS {n}" for i, (n, m) in enumerate(_VARIED.items()))


@query(f"""WITH h AS (SELECT o_orderkey, {_varied_sql().replace('k ', 'o_orderkey ')} FROM orders)
SELECT o_orderkey, CAST(CASE WHEN version_major <> 1 THEN -3 WHEN flags > 1 THEN -9 WHEN profile NOT IN (3, 5, 6, 7) THEN -4 WHEN (profile = 7) <> (pixel_format = 3) THEN -9 WHEN profile = 7 AND (alpha_mode <> 0 OR qmatrix_id <> 0) THEN -9
WHEN profile IN (5, 6) AND pixel_format = 0 THEN -9 WHEN profile = 6 AND bit_depth <> 12 THEN -9 WHEN pixel_format > 3 THEN -5 WHEN bit_depth NOT IN (10, 12, 16) THEN -5
WHEN 0 < CASE WHEN bit_depth = 16 THEN 6 WHEN pixel_format = 3 THEN 5 WHEN qp_base >= 64 THEN 4 WHEN pixel_format = 2 THEN 3 WHEN pixel_format = 1 THEN 2 WHEN bit_depth = 12 THEN 1 ELSE 0 END THEN -3
WHEN alpha_mode > 2 THEN -7 WHEN alpha_mode <> 0 THEN -9 WHEN qmatrix_id > 3 THEN -6 WHEN qp_base > 95 THEN -9 WHEN pixel_format = 2 THEN -9 WHEN chroma_siting > 2 THEN -9 ELSE 0 END AS INTEGER) AS status FROM h""")
def header_status(spark, sf_dir):
    """Packets of three empty slices whose headers differ in one field: the first rule that each breaks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    lit = lambda v: F.lit(v).cast("bigint")
    empty = F.array(*[F.struct(lit(i).alias("plane"), lit(0).alias("block_y0"), lit(3).alias("block_h"), lit(64).alias("qp_delta_biased"), lit(0).alias("k1"), lit(0).alias("k2"), lit(0).alias("k3"), F.unhex(F.lit("00")).alias("payload")) for i in range(3)])
    made = packet.built(o, {**CONFIG, **varied(F.col("o_orderkey"))}, empty)
    return packet.parsed(made).select("o_orderkey", "status")


@query(f"""WITH h AS (SELECT o_orderkey, {_varied_sql().replace('k ', 'o_orderkey ')} FROM orders) SELECT o_orderkey, profile = 3 AND pixel_format = 0 AND bit_depth = 10 AND alpha_mode = 0 AND chroma_siting = 0 AS same FROM h""")
def header_vs_movie(spark, sf_dir):
    """Whether each header says the same as the movie's configuration."""
    v = varied(F.col("o_orderkey"))
    names = ("profile", "pixel_format", "bit_depth", "alpha_mode", "chroma_siting")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(*[v[n].alias(n) for n in names]).alias("h"))
    c = F.struct(*[F.lit(CONFIG.get(n, 0)).cast("bigint").alias(n) for n in names])
    return o.select("o_orderkey", rules.same_config(F.col("h"), c, names).alias("same"))


# ---- movies -------------------------------------------------------------------------------------------------


def movies(spark, sf_dir) -> DataFrame:
    """movie, samples, timescale, width, height, config, meta: each user's events as frames of a movie. A frame's bytes
    are its event's id over and over (its size modulo 50, and 8 more), its duration 1 or 2; signups are sync samples
    (and the first frame). There is a timecode, a tier and a budget."""
    f = frames(spark, sf_dir)
    data = F.rpad(F.col("event_id").cast("string"), (F.col("size") % 50 + 8).cast("int"), F.lit(".")).cast("binary")
    s = f.select("user_id", F.struct("ts", "event_id", data.alias("data"), (F.col("event_id") % 2 + 1).alias("dur"), (F.col("event_type") == "signup").alias("sync")).alias("x"))
    rows = s.groupBy(F.col("user_id").alias("movie")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    samples = F.transform("x", lambda x, i: F.struct(x["data"].alias("data"), x["dur"].alias("dur"), (x["sync"] | (i == 0)).alias("sync")))
    config = F.create_map(*[F.lit(v) for kv in (("profile", 3), ("bit_depth", 10), ("qp_base", 40), ("color_primaries", 1), ("color_transfer", 1), ("color_matrix", 1), ("sar_num", 4), ("sar_den", 3)) for v in kv])
    chunk = lambda i: F.struct(F.rpad(F.lit("a"), 16, "a").cast("binary").alias("data"), F.lit(1024).cast("bigint").alias("dur"))
    rate = F.when(F.col("movie") % 2 == 0, 48000).otherwise(96000).cast("bigint")
    audio = F.array(F.struct(F.lit("lpcm").alias("codec"), rate.alias("rate"), F.lit(2).alias("channels"), F.lit(16).alias("bits"), F.lit(0).cast("bigint").alias("priming"), F.transform(F.sequence(F.lit(1), (F.col("movie") % 4 + 1).cast("int")), chunk).alias("chunks")))
    meta = F.struct(
        (F.col("movie") % 8 + 1).cast("int").alias("tier"), F.lit("planes").alias("vendor"), F.concat(F.lit("tier "), F.col("movie") % 8 + 1).alias("label"), F.lit(2500).alias("target_bp"),
        (F.col("movie") * 1000).cast("int").alias("actual_bp"), F.lit(15).alias("max_error"), (F.col("movie") * 10).alias("tc_start"), F.lit(30).alias("tc_fps"), F.lit(1).alias("tc_drop"), audio.alias("audio"),
    )
    return rows.select("movie", samples.alias("samples"), F.lit(25).alias("timescale"), F.lit(60).alias("width"), F.lit(20).alias("height"), config.alias("config"), meta.alias("meta"))


_MV = f"""{_FR}, m AS (SELECT user_id AS movie, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, greatest(8 + size % 50, 0) AS size, event_id % 2 + 1 AS dur FROM fr),
sm AS (SELECT movie, idx, event_id, 36 + coalesce(sum(size) OVER w, 0) AS off, size, coalesce(sum(dur) OVER w, 0) AS pts, dur, event_type = 'signup' OR idx = 0 AS sync FROM m WINDOW w AS (PARTITION BY movie ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_MV} SELECT movie, CAST(idx AS BIGINT) AS idx, CAST(off AS BIGINT) AS off, CAST(size AS BIGINT) AS size, CAST(pts AS BIGINT) AS pts, CAST(dur AS BIGINT) AS dur, sync FROM sm")
def movie_samples(spark, sf_dir):
    """The sample table that reading the written movies gives."""
    i = movie.index_of(movie.written(movies(spark, sf_dir)))
    return i.select("movie", F.posexplode("samples").alias("idx", "s")).select("movie", F.col("idx").cast("bigint").alias("idx"), "s.*")


@query(f"""WITH {_MV}, k AS (SELECT movie, count(*) AS n FROM sm GROUP BY movie) SELECT movie, CAST(0 AS INTEGER) AS status, CAST(25 AS BIGINT) AS timescale, CAST(60 AS INTEGER) AS width, CAST(20 AS INTEGER) AS height, false AS faststart, CAST(movie % 8 + 1 AS INTEGER) AS tier, 'tier ' || (movie % 8 + 1) AS label, CAST(3 AS INTEGER) AS profile,
CAST(least(movie * 1000, 65535) AS INTEGER) AS actual_bp, CAST(15 AS INTEGER) AS max_error, CAST(movie * 10 AS BIGINT) AS tc_start, CAST(n AS BIGINT) AS n, CAST(movie % 4 + 1 AS BIGINT) AS chunks, CAST(CASE WHEN movie % 2 = 0 THEN 48000 ELSE 96000 END AS BIGINT) AS rate FROM k""")
def movie_info(spark, sf_dir):
    """Metadata of the written movies: configuration, tier, budget, timecode, audio."""
    i = movie.index_of(movie.written(movies(spark, sf_dir)))
    a = F.get("audio", F.lit(0))
    return i.select("movie", "status", "timescale", "width", "height", "faststart", "tier", "label", "profile", "actual_bp", "max_error", "tc_start", F.size("samples").cast("bigint").alias("n"), F.size(a["chunks"]).cast("bigint").alias("chunks"), a["rate"].alias("rate"))


@query(f"WITH {_MV} SELECT movie, CAST(idx AS BIGINT) AS idx, rpad(CAST(event_id AS VARCHAR), CAST(size AS INTEGER), '.') AS data FROM sm WHERE idx >= 3 AND idx < 9")
def movie_packets(spark, sf_dir):
    """The bytes of samples 3 to 8 of every movie."""
    p = movie.packets(movie.written(movies(spark, sf_dir)), 3, 9)
    return p.select("movie", F.col("idx").cast("bigint").alias("idx"), F.col("data").cast("string").alias("data"))


@query(f"""WITH {_MV}, k AS (SELECT movie, count(*) AS n, sum(size) AS b, count(*) FILTER (sync) AS s, movie % 4 + 1 AS c FROM sm GROUP BY movie), r AS (SELECT movie, count(*) FILTER (dur IS DISTINCT FROM p) AS r FROM (SELECT movie, dur, lag(dur) OVER (PARTITION BY movie ORDER BY idx) AS p FROM sm) GROUP BY movie)
SELECT movie, unnest(['mdat', 'moov/trak/mdia/minf/stbl/stts', 'moov/trak/mdia/minf/stbl/stsz', 'moov/trak/mdia/minf/stbl/stco', 'moov/trak/mdia/minf/stbl/stss']) AS path,
unnest([CAST(16 + b + 16 * c + 4 AS BIGINT), CAST(16 + 8 * r AS BIGINT), CAST(20 + 4 * n AS BIGINT), CAST(16 + 4 * n AS BIGINT), CAST(16 + 4 * s AS BIGINT)]) AS size FROM k JOIN r USING (movie)""")
def movie_atoms(spark, sf_dir):
    """Sizes of the data and of the video track's tables (the first of each kind)."""
    a = movie.atoms_of(movie.written(movies(spark, sf_dir)))
    kinds = ["mdat", *[f"moov/trak/mdia/minf/stbl/{t}" for t in ("stts", "stsz", "stco", "stss")]]
    return a.filter(F.col("path").isin(kinds)).groupBy("movie", "path").agg(F.min(F.struct("n", "size")).alias("x")).select("movie", "path", "x.size")


@query(f"""WITH {_MV} SELECT movie, CAST(idx AS BIGINT) AS idx, true AS faststart, CAST(off - min(off) OVER (PARTITION BY movie) AS BIGINT) AS rel, CAST(size AS BIGINT) AS size, rpad(CAST(event_id AS VARCHAR), CAST(size AS INTEGER), '.') AS data FROM sm""")
def movie_faststart(spark, sf_dir):
    """Rewritten with the index first: the same samples, whose bytes stand where the index says."""
    files = movie.faststart(movie.written(movies(spark, sf_dir)))
    i = movie.sample_bytes(files)
    return i.select("movie", F.col("idx").cast("bigint").alias("idx"), "faststart", (F.col("off") - F.col("first")).alias("rel"), "size", F.col("data").cast("string").alias("data"))


@query(f"""WITH {_MV} SELECT movie, CAST(idx AS BIGINT) AS idx, CAST(36 + 5000 + off - 36 + (movie % 3) * 4294967296 AS BIGINT) AS off, max(off + 5000 + (movie % 3) * 4294967296) OVER (PARTITION BY movie) > 4294967295 AS wide FROM sm""")
def faststart_offsets(spark, sf_dir):
    """Offsets behind an index of 5,000 bytes (and 4 or 8 GB more for two thirds of the movies), and which tables then need 64 bits."""
    s = movies(spark, sf_dir).select("movie", F.posexplode("samples").alias("idx", "s")).select("movie", F.col("idx").cast("bigint").alias("idx"), F.octet_length("s.data").cast("bigint").alias("size"))
    return movie.faststart_offsets(s, ["movie"], F.lit(5000) + (F.col("movie") % 3) * 4294967296, ["idx"])


@query(f"""WITH {_MV}, t AS (SELECT movie, idx, movie * 10 + idx AS f FROM sm), n AS (SELECT *, f + (f // 17982) * 18 + CASE WHEN f % 17982 >= 1800 THEN ((f % 17982 - 1800) // 1798 + 1) * 2 ELSE 0 END AS n FROM t)
SELECT movie, CAST(idx AS BIGINT) AS idx, lpad(CAST(n // 108000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n // 1800 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n // 30 % 60 AS VARCHAR), 2, '0') || ';' || lpad(CAST(n % 30 AS VARCHAR), 2, '0') AS tc, round(pts / 25.0, 6) AS seconds FROM n JOIN sm USING (movie, idx)""")
def movie_timecodes(spark, sf_dir):
    """Every frame's label, from the movie's first one, and its time."""
    i = movie.index_of(movie.written(movies(spark, sf_dir))).select("movie", "timescale", "tc_start", F.posexplode("samples").alias("idx", "s"))
    return i.select("movie", F.col("idx").cast("bigint").alias("idx"), scalar.two_hour_digits(scalar.timecode(F.col("tc_start") + F.col("idx"))).alias("tc"), F.round(scalar.seconds(F.col("s.pts"), F.col("timescale")), 6).alias("seconds"))


@query(f"""WITH {_MV} SELECT movie, '{{"movie":' || movie || ',"layout":"standard","width":60,"height":20,"timescale":25,"sample_count":' || count(*) || ',"duration_ticks":' || CAST(sum(dur) AS BIGINT) || ',"sync_samples":' || count(*) FILTER (sync) || '}}' AS json FROM sm GROUP BY movie""")
def movie_probe(spark, sf_dir):
    """A line of JSON for each movie."""
    i = movie.index_of(movie.written(movies(spark, sf_dir)))
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, s: a + s["dur"])
    layout = F.when(F.col("faststart"), "faststart").otherwise("standard")
    return i.select("movie", F.to_json(F.struct("movie", layout.alias("layout"), "width", "height", "timescale", F.size("samples").alias("sample_count"), total.alias("duration_ticks"), F.size(F.filter("samples", lambda s: s["sync"])).alias("sync_samples"))).alias("json"))


@query("""WITH r AS (SELECT o_custkey % 50 AS movie, o_orderkey AS run, o_orderkey % 5 + 1 AS n, o_orderkey % 3 + 1 AS dur FROM orders), b AS (SELECT *, coalesce(sum(n) OVER w, 0) AS i, coalesce(sum(n * dur) OVER w, 0) AS p FROM r WINDOW w AS (PARTITION BY movie ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT movie, CAST(i + k AS BIGINT) AS idx, CAST(p + k * dur AS BIGINT) AS pts, dur FROM (SELECT *, unnest(range(n)) AS k FROM b)""")
def stts_expand(spark, sf_dir):
    """Runs of equal durations as samples with their times."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("movie"), F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 5 + 1).alias("n"), (F.col("o_orderkey") % 3 + 1).alias("dur"))
    return movie.durations(o, ["movie"])


@query("""WITH o AS (SELECT o_custkey % 50 AS movie, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS k, o_orderkey FROM orders),
c AS (SELECT movie, k AS chunk, o_orderkey * 1000 AS off, CASE WHEN k < 4 THEN 2 WHEN k < 9 THEN 1 ELSE 3 END AS per FROM o),
s AS (SELECT movie, chunk, off, coalesce(sum(per) OVER (PARTITION BY movie ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + k AS idx, k FROM (SELECT *, unnest(range(per)) AS k FROM c)),
t AS (SELECT movie, chunk, off, per, coalesce(sum(per) OVER (PARTITION BY movie ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM c),
e AS (SELECT movie, chunk, off, i + unnest(range(per)) AS idx FROM t), z AS (SELECT *, idx % 90 + 10 AS size FROM e)
SELECT movie, CAST(idx AS BIGINT) AS idx, chunk, CAST(off + coalesce(sum(size) OVER (PARTITION BY movie, chunk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, CAST(size AS BIGINT) AS size FROM z""")
def chunk_samples(spark, sf_dir):
    """Samples laid into chunks: two each for the first three chunks, one up to the eighth, then three."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("movie"), "o_orderkey")
    w = Window.partitionBy("movie").orderBy("o_orderkey")
    chunks = o.select("movie", F.row_number().over(w).cast("bigint").alias("chunk"), (F.col("o_orderkey") * 1000).alias("off"), F.lead("o_orderkey").over(w).isNull().alias("last"))
    runs = o.select("movie").distinct().select("movie", F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("first"), F.lit(p).cast("bigint").alias("per")) for a, p in ((1, 2), (4, 1), (9, 3))])).alias("r")).select("movie", "r.*")
    # 0 to three times the number of chunks, made by the chunks: not by one task
    n = chunks.select("movie", F.explode(F.sequence((F.col("chunk") - 1) * 3, F.col("chunk") * 3 - F.when(F.col("last"), 0).otherwise(1))).alias("idx"))
    out = movie.chunk_samples(runs, chunks.drop("last"), n.withColumn("size", F.col("idx") % 90 + 10), ["movie"])
    return out


# ---- images -------------------------------------------------------------------------------------------------


def images(spark, sf_dir) -> DataFrame:
    """page_id, content: a description, the page as pixels, its address as a name; of every fifth file the pixels' last
    byte is cut off, of every seventh the second chunk stands twice."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("html"), F.col("url").cast("binary").alias("url"))
    chunk = lambda t, f, d: F.struct(F.lit(t).alias("fourcc"), F.lit(f).cast("bigint").alias("flags"), d.alias("data"))
    three = [chunk("IDSC", image.CRITICAL, F.rpad(F.lit("i"), 128, "i").cast("binary")), chunk("PIXL", image.CRITICAL, F.col("html")), chunk("OCIO", image.OPTIONAL, F.col("url"))]
    made = image.built(p, F.when(F.col("page_id") % 7 == 0, F.array(*three, three[1])).otherwise(F.array(*three)))
    return made.withColumn("content", F.when(F.col("page_id") % 5 == 0, F.substring("content", F.lit(1), F.octet_length("content") - 1)).otherwise(F.col("content")))


_IMG = "p AS (SELECT page_id, octet_length(encode(html)) AS n, octet_length(encode(url)) AS u, url, CASE WHEN page_id % 5 = 0 THEN -101 WHEN page_id % 7 = 0 THEN -102 ELSE 0 END AS status FROM pages)"


@query(f"WITH {_IMG} SELECT page_id, CAST(status AS INTEGER) AS status, CASE WHEN status <> -101 THEN url END AS name, CAST(CASE WHEN status = -101 THEN 0 WHEN status = -102 THEN 4 ELSE 3 END AS BIGINT) AS chunks FROM p")
def image_probe(spark, sf_dir):
    """Status of each file, the name inside, and how many chunks it has; no pixel is looked at but for checksums."""
    i = image.parsed(images(spark, sf_dir))
    return i.select("page_id", "status", image.chunk(F.col("content"), F.col("chunks"), "OCIO").cast("string").alias("name"), F.size("chunks").cast("bigint").alias("chunks"))


@query(f"""WITH {_IMG}, c AS (SELECT page_id, n, u, unnest([0, 1, 2]) AS k FROM p WHERE status = 0)
SELECT page_id, CAST(k AS BIGINT) AS n, ['IDSC', 'PIXL', 'OCIO'][k + 1] AS fourcc, CAST(160 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 128 ELSE 128 + n END AS BIGINT) AS off, CAST(CASE k WHEN 0 THEN 128 WHEN 1 THEN n ELSE u END AS BIGINT) AS size, true AS ok FROM c""")
def image_chunks(spark, sf_dir):
    """The directory of every file that can be read."""
    i = image.parsed(images(spark, sf_dir)).filter("status = 0").select("page_id", F.explode("chunks").alias("c"))
    return i.select("page_id", F.col("c.n").cast("bigint").alias("n"), "c.fourcc", "c.off", "c.size", "c.ok")


@query("""WITH e AS (SELECT l_orderkey % 2000 AS f, l_linenumber AS n, l_partkey % 3 AS t, sum(l_suppkey % 7 + 1) OVER (PARTITION BY l_orderkey % 2000 ORDER BY l_linenumber, l_orderkey, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - (l_partkey % 40 // 39) AS off, l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM lineitem),
k AS (SELECT f, t, off, row_number() OVER (PARTITION BY f ORDER BY n, l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS n FROM e),
o AS (SELECT f, t, coalesce(off < lag(off + 1) OVER (PARTITION BY f ORDER BY n), false) AS over, t = 0 AND count(*) OVER (PARTITION BY f, t) > 1 AS twice FROM k)
SELECT f, NOT bool_or(over OR twice) AS ok FROM o GROUP BY f""")
def directory_check(spark, sf_dir):
    """Directories as rows: whether chunks overlap or a critical kind stands twice."""
    li = table(spark, sf_dir, "lineitem").withColumn("f", F.col("l_orderkey") % 2000)
    w = Window.partitionBy("f").orderBy("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    off = F.sum(F.col("l_suppkey") % 7 + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.floor((F.col("l_partkey") % 40) / 39)
    e = li.select("f", F.row_number().over(w).alias("n"), (F.col("l_partkey") % 3).cast("string").alias("fourcc"), F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(2).alias("flags"), off.alias("off"), F.lit(1).alias("size"))
    return image.directory_rows(e, ["f"])

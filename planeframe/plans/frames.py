"""Queries over whole frames: every 20 vectors are the luma rows of a 4:2:2 frame of 64 x 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from planeframe import engine, tables as T
from planeframe.functions import binary as B
from planeframe.operators import block, plane, sample
from planeframe.plans.codes import BOOKS
from planeframe.plans.planes import H, W, _P, cells, planes
from planeframe.queries import _F, _X, _Z, _q, blocks, query
from planeframe.sources import image, packet, synthetic

CODED = engine.Config(W, H, 76)


def pictures(spark, sf_dir) -> DataFrame:
    """f, plane, y, s: luma, its halved rows, and the halved rows of its negative."""
    p = planes(spark, sf_dir)
    three = F.array(*[F.struct(F.lit(i).cast("bigint").alias("plane"), s.alias("s")) for i, s in enumerate((F.col("s"), sample.pairs_422(F.col("s")), sample.pairs_422(F.transform("s", lambda v: F.lit(1023) - v))))])
    return p.select("f", "y", F.explode(three).alias("x")).select("f", "x.plane", "y", "x.s")


_SRC = f"""{_P}, src AS (SELECT f, 0 AS p, y, x, s FROM pl UNION ALL SELECT f, 1, y, x // 2, CAST((sum(s) + 1) // 2 AS BIGINT) FROM pl GROUP BY f, y, x // 2 UNION ALL SELECT f, 2, y, x // 2, CAST((sum(1023 - s) + 1) // 2 AS BIGINT) FROM pl GROUP BY f, y, x // 2),
pad AS (SELECT f, p, t.range AS y, x, s FROM src JOIN range(24) t ON y = least(t.range, {H - 1})),
x AS (SELECT ((f * 3 + p) * 3 + y // 8) * 8 + x // 8 AS blk, 0 AS label, y % 8 * 8 + x % 8 AS i, s FROM pad)"""
_SRC = _SRC.replace(_X, _X.replace("x AS", "x0 AS", 1)).replace("FROM x)", "FROM x0)", 1)
_DEC = f"""{_F.replace(_X, _SRC)}, {_q(CODED.qp)}, ww(u, c) AS (VALUES {", ".join(f"({u}, {T.E[u]})" for u in range(8))}),
d AS (SELECT q.blk, q.i, q.c * {T.flat_step(CODED.qp)} * ((4294967296 + a.c * b.c // 2) // (a.c * b.c)) AS c FROM q JOIN ww a ON a.u = q.i // 8 JOIN ww b ON b.u = q.i % 8),
p2 AS (SELECT d.blk, d.i // 8 AS u, m.k AS xx, sum(d.c * m.c) AS a FROM d JOIN m ON m.u = d.i % 8 GROUP BY ALL),
r AS (SELECT p2.blk, CAST(m.k * 8 + p2.xx AS BIGINT) AS i, sum(p2.a * m.c) AS a FROM p2 JOIN m ON m.u = p2.u GROUP BY ALL),
o AS (SELECT blk // 72 AS f, blk // 24 % 3 AS plane, blk // 8 % 3 * 8 + i // 8 AS y, blk % 8 * 8 + i % 8 AS x, greatest(0, least(1023, 512 + CAST(sign(a) * ((abs(a) + 2147483648) // 4294967296) AS BIGINT))) AS s FROM r)"""


@query(f"WITH {_DEC} SELECT f, plane, y, x, CAST(s AS BIGINT) AS s FROM o WHERE y < {H}")
def codec_roundtrip(spark, sf_dir):
    """Frames to packets and back: what transform, quantiser and their inverses leave of them."""
    rows, _ = engine.decode(engine.encode(pictures(spark, sf_dir), CODED), CODED)
    return cells(rows, "f", "plane")


@query(f"""WITH {_DEC}, z AS (SELECT f, plane, y, x, CASE WHEN f % 3 = 1 AND plane = 0 AND y < 16 THEN 512 ELSE s END AS s FROM o WHERE y < {H}) SELECT f, CAST(CASE WHEN f % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS status, plane, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * (y * 64 + x + 1)) AS BIGINT) AS weighed FROM z GROUP BY f, plane""")
def codec_damage(spark, sf_dir):
    """The same with a byte of the first slice flipped in every third frame: that slice is grey, all others are whole."""
    p = engine.encode(pictures(spark, sf_dir), CODED)
    at = packet.HEADER_SIZE + packet.SLICE_SIZE
    flipped = F.concat(F.substring("content", 1, at), B.to_be(B.be(F.col("content"), at, 1).bitwiseXOR(F.lit(85)), 1), F.expr(f"substring(content, {at + 2}, octet_length(content))"))
    rows = engine.decoded(p.withColumn("content", F.when(F.col("f") % 3 == 1, flipped).otherwise(F.col("content"))), CODED)
    each = cells(rows, "f", "plane", "bad").groupBy("f", "plane").agg(F.sum("s").alias("total"), F.sum(F.col("s") * (F.col("y") * 64 + F.col("x") + 1)).alias("weighed"), F.max("bad").alias("bad"))
    status = F.max("bad").over(Window.partitionBy("f")).cast("int").alias("status")
    return each.select("f", status, "plane", "total", "weighed")


PICTURE = engine.Config(W // 2, H, 60, pixel_format=0)


@query(f"WITH {_P} SELECT f, CAST(0 AS INTEGER) AS status, CAST({W // 2} AS BIGINT) AS width, CAST({H} AS BIGINT) AS height, CAST(3 AS BIGINT) AS profile, CAST(0 AS BIGINT) AS image_profile, CAST({W // 2} * {H} AS BIGINT) AS samples, true AS close FROM (SELECT DISTINCT f FROM pl)")
def image_decode(spark, sf_dir):
    """Halved frames as image files around their packets and back: what the description says, and that luma comes out close.
    A frame with fewer rows is coded, and compared, with its last row repeated."""
    p = planes(spark, sf_dir).select("f", "y", sample.pairs_422(F.col("s")).alias("s"))
    three = F.array(*[F.struct(F.lit(i).cast("bigint").alias("plane"), s.alias("s")) for i, s in enumerate((F.col("s"), sample.pairs_422(F.col("s")), sample.pairs_422(F.col("s"))))])
    made = image.with_packet(engine.encode(p.select("f", "y", F.explode(three).alias("x")).select("f", "x.plane", "y", "x.s"), PICTURE))
    read = image.packets_of(made)
    h = packet.header(F.col("packet"))
    about = read.select("f", "status", h["visible_width"].alias("width"), h["visible_height"].alias("height"), h["profile"].alias("profile"), image.described(h)["image_profile"].alias("image_profile"))
    rows, _ = engine.decode(read.select("f", F.col("packet").alias("content")), PICTURE)
    worst = F.array_max(F.zip_with("s", "was", lambda a, b: F.abs(a - b)))
    both = rows.filter("plane = 0").select("f", "y", "s").join(plane.padded(p, ["f"], W // 2, H).withColumnRenamed("s", "was"), ["f", "y"]).groupBy("f").agg(F.sum(F.size("s")).alias("samples"), (F.max(worst) <= 40).alias("close"))
    return about.join(both, "f")


_STEPS = "st(qp, step) AS (VALUES " + ", ".join(f"({q}, {T.flat_step(q)})" for q in range(96)) + ")"
_LEN = {f: f"[{', '.join(map(str, BOOKS[f]))}]" for f in BOOKS}


def _cost(lens: str, m: str) -> str:
    cat = f"CASE WHEN {m} > 0 THEN length(bin({m})) ELSE 0 END"
    return f"({lens}[{cat} + 1] + greatest({cat} - 1, 0))"


@query(f"""WITH {_F}, {_STEPS}, {_Z}, sc AS (SELECT f.blk, f.label, z.pos, f.c FROM f JOIN z ON z.i = f.i),
lv AS (SELECT blk, label, qp, pos, c, CAST(greatest(0, (abs(c) + step // 2 - CASE WHEN pos = 0 THEN 0 ELSE step // 4 END) // step) AS BIGINT) AS n FROM sc, st),
nz AS (SELECT *, CASE WHEN c < 0 AND n > 0 THEN 2 * n - 1 ELSE 2 * n END AS m FROM lv WHERE pos = 0 OR n > 0),
rn AS (SELECT label, CASE WHEN pos = 0 THEN {_cost(_LEN['dc'], 'm')} + {BOOKS['run'][63]} ELSE {_cost(_LEN['level'], 'm')} + {_LEN['run']}[pos - lag(pos) OVER (PARTITION BY blk, qp ORDER BY pos)] END AS bits, qp FROM nz),
t AS (SELECT label, qp, sum(bits) AS bits FROM rn GROUP BY ALL), k AS (SELECT label, count(*) * 150 AS target FROM (SELECT DISTINCT label, blk FROM x) GROUP BY label),
b AS (SELECT label, qp, bits, bits <= target AS fits FROM t JOIN k USING (label))
SELECT label, CAST(coalesce(min(qp) FILTER (fits), 95) AS BIGINT) AS qp, CAST(coalesce(arg_min(bits, qp) FILTER (fits), arg_max(bits, qp)) AS BIGINT) AS bits FROM b GROUP BY label""")
def sized_encode(spark, sf_dir):
    """The smallest of all 96 qps at which a label's blocks take 150 bits each at most, coded exactly."""
    b = block.scan(block.forward(blocks(spark, sf_dir)))
    return engine.sized_qp(b, ["label"], F.col("blocks") * 150, (BOOKS["dc"], BOOKS["level"], BOOKS["run"]))


@query("""WITH k AS (SELECT unnest(['flat', 'gradient', 'detail']) AS kind), g AS (SELECT kind, f.range AS f, y.range AS y, x.range AS x FROM k, range(3) f, range(40) y, range(100) x)
SELECT kind, f, y, x, CAST(least(1023, CASE kind WHEN 'flat' THEN 320 + (x // 32 + y // 32) % 3 * 6 WHEN 'gradient' THEN 64 + x * 700 // 99 + y * 300 // 39 ELSE CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 180 ELSE 760 END + CASE WHEN (x + y) % 16 < 2 THEN 200 ELSE 0 END END) AS BIGINT) AS s FROM g""")
def synthetic_planes(spark, sf_dir):
    """Three frames of 100 x 40 of each kind that follows from the place."""
    out = None
    for kind in ("flat", "gradient", "detail"):
        p = synthetic.planes(spark, 3, kind, 100, 40).withColumn("kind", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    return cells(out, "kind", "f")




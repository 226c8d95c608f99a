"""Queries over planes: every 20 vectors are the rows of a plane of 64 x 20 samples of 10 bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from planeframe import tables as T
from planeframe.operators import block, control, metric, plane, sample
from planeframe.queries import _F, _X, QP, _long, blocks, query, samples

W, H = 64, 20


def planes(spark, sf_dir) -> DataFrame:
    """f (frame), y, s."""
    s = samples(spark, sf_dir)
    return s.select(F.floor(F.col("blk") / H).cast("bigint").alias("f"), (F.col("blk") % H).alias("y"), "s")


def cells(df: DataFrame, *keys: str, s: str = "s") -> DataFrame:
    """One row a sample: keys, y, x, s."""
    return df.select(*keys, "y", F.posexplode(s).alias("x", "c")).select(*keys, "y", F.col("x").cast("bigint").alias("x"), F.col("c").cast("bigint").alias("s"))


_P = f"{_X}, pl AS (SELECT blk // {H} AS f, blk % {H} AS y, i AS x, s FROM x)"


@query(f"WITH {_P} SELECT f, y, x, s FROM pl WHERE x < 50 AND y < 13")
def plane_crop(spark, sf_dir):
    return cells(plane.crop(planes(spark, sf_dir), 50, 13), "f")


@query(f"""WITH {_P}, m AS (SELECT f, max(y) AS ly FROM pl GROUP BY f) SELECT m.f, CAST(gy.range AS BIGINT) AS y, CAST(gx.range AS BIGINT) AS x, pl.s FROM m, range({H + 4}) gy, range({W + 8}) gx JOIN pl ON pl.f = m.f AND pl.y = least(gy.range, m.ly) AND pl.x = least(gx.range, {W - 1})""")
def plane_pad(spark, sf_dir):
    """Planes of 72 x 24, the last column and row repeated."""
    return cells(plane.padded(planes(spark, sf_dir), ["f"], W + 8, H + 4), "f")


def _delta(p1: str, p0: str, q0: str, q1: str, alpha: int, beta: int, clip: int) -> str:
    d = f"CAST(floor((12 * ({q0} - {p0}) + 4 * ({p1} - {q1}) + 8) / 16.0) AS BIGINT)"
    half = f"CASE WHEN {q0} >= {p0} THEN greatest(0, least({d}, ({q0} - {p0}) // 2)) ELSE least(0, greatest({d}, -(({p0} - {q0}) // 2))) END"
    return f"CASE WHEN abs({q0} - {p0}) < {alpha} AND abs({p1} - {p0}) < {beta} AND abs({q1} - {q0}) < {beta} THEN greatest(-{clip}, least({clip}, {half})) ELSE 0 END"


def _deblock_pass(name: str, of: str, axis: str, other: str, most: int, alpha: int, beta: int, clip: int) -> str:
    taps = " ".join(f"LEFT JOIN {of} t{k} ON t{k}.f = c.f AND t{k}.{other} = c.{other} AND t{k}.{axis} = (c.{axis} + 2) // 4 * 4 + {k - 2}" for k in range(4))
    d = _delta("t0.s", "t1.s", "t2.s", "t3.s", alpha, beta, clip)
    return f"""{name}d AS (SELECT c.f, c.y, c.x, c.s, c.{axis} - (c.{axis} + 2) // 4 * 4 + 2 AS p, (c.{axis} + 2) // 4 * 4 AS e, {d} AS d FROM {of} c {taps}),
{name} AS (SELECT f, y, x, CASE WHEN e > 0 AND e < {most} THEN greatest(0, least(1023, s + CASE p WHEN 0 THEN CAST(floor(d / 2.0) AS BIGINT) WHEN 1 THEN d WHEN 2 THEN -d ELSE -CAST(floor(d / 2.0) AS BIGINT) END)) ELSE s END AS s FROM {name}d)"""


_A = plane.strength(78)


@query(f"WITH {_P}, {_deblock_pass('v', 'pl', 'x', 'y', W, *_A)}, {_deblock_pass('h', 'v', 'y', 'x', H, *_A)} SELECT f, y, x, CAST(s AS BIGINT) AS s FROM h")
def plane_deblock(spark, sf_dir):
    """Both passes at half size, where boundaries stand every four samples."""
    return cells(plane.deblock(planes(spark, sf_dir), ["f"], W, H, 78, unit=4), "f")


def _lift(name: str, of: str, axis: str, other: str) -> str:
    """Low and detail along an axis: f, b, other, j, low, d."""
    return f"""{name}n AS (SELECT *, lead(s) OVER w AS n1, lead(s, 2) OVER w AS n2 FROM {of} WINDOW w AS (PARTITION BY f, b, {other} ORDER BY {axis})),
{name}d AS (SELECT f, b, {other}, {axis} // 2 AS j, s, CASE WHEN n1 IS NOT NULL THEN CAST(n1 - floor((s + coalesce(n2, s)) / 2.0) AS BIGINT) END AS d FROM {name}n WHERE {axis} % 2 = 0),
{name} AS (SELECT *, CAST(s + floor((coalesce(lag(d) OVER (PARTITION BY f, b, {other} ORDER BY j), 0) + coalesce(d, 0) + 2) / 4.0) AS BIGINT) AS low FROM {name}d)"""


_BANDS = f"""{_P}, src AS (SELECT f, '' AS b, y, x, s FROM pl), {_lift('r', 'src', 'x', 'y')},
half AS (SELECT f, 'l' AS b, y, j AS x, low AS s FROM r UNION ALL SELECT f, 'h', y, j, d FROM r WHERE d IS NOT NULL), {_lift('c', 'half', 'y', 'x')}"""


@query(f"WITH {_BANDS} SELECT f, b || 'l' AS band, j AS y, x, low AS s FROM c UNION ALL SELECT f, b || 'h', j, x, d FROM c WHERE d IS NOT NULL")
def pyramid_bands(spark, sf_dir):
    """One level of the reversible pyramid in both directions."""
    return cells(plane.analyse2(planes(spark, sf_dir), ["f"]), "f", "band")


@query(f"WITH {_P} SELECT f, y, x, s FROM pl")
def pyramid_roundtrip(spark, sf_dir):
    """The pyramid's bands put together are the plane."""
    return cells(plane.synthesise2(plane.analyse2(planes(spark, sf_dir), ["f"]), ["f"]), "f")


_SMALL = (24, 9)
_AREA = f"""{_P}, tx AS (SELECT range AS d FROM range({_SMALL[0]})), ty AS (SELECT range AS t FROM range({_SMALL[1]})),
ox AS (SELECT pl.f, pl.y, d, sum(s * (least((d + 1) * {W}, (x + 1) * {_SMALL[0]}) - greatest(d * {W}, x * {_SMALL[0]}))) AS v FROM pl JOIN tx ON (d + 1) * {W} > x * {_SMALL[0]} AND d * {W} < (x + 1) * {_SMALL[0]} GROUP BY ALL),
base AS (SELECT f, t AS y, d AS x, CAST((sum(v * (least((t + 1) * {H}, (y + 1) * {_SMALL[1]}) - greatest(t * {H}, y * {_SMALL[1]}))) + {W * H // 2}) // {W * H} AS BIGINT) AS s FROM ox JOIN ty ON (t + 1) * {H} > y * {_SMALL[1]} AND t * {H} < (y + 1) * {_SMALL[1]} GROUP BY f, t, d)"""


def _centre(name: str, src: int, dst: int) -> str:
    return f"""{name}0 AS (SELECT range AS d, greatest(0, (2 * range + 1) * {src} - {dst}) AS num FROM range({dst})),
{name} AS (SELECT d, least({src - 1}, num // {2 * dst}) AS a, CASE WHEN num // {2 * dst} >= {src - 1} THEN 0 ELSE num % {2 * dst} END AS fr, least({src - 1}, least({src - 1}, num // {2 * dst}) + 1) AS b FROM {name}0)"""


_UP = f"""{_AREA}, {_centre('cx', _SMALL[0], W)}, {_centre('cy', _SMALL[1], H)},
wide AS (SELECT p.f, p.y, cx.d AS x, p.s * ({2 * W} - cx.fr) + q.s * cx.fr AS v FROM cx JOIN base p ON p.x = cx.a JOIN base q ON q.f = p.f AND q.y = p.y AND q.x = cx.b),
up AS (SELECT p.f, cy.d AS y, p.x, CAST((p.v * ({2 * H} - cy.fr) + q.v * cy.fr + {2 * W * H}) // {4 * W * H} AS BIGINT) AS s FROM cy JOIN wide p ON p.y = cy.a JOIN wide q ON q.f = p.f AND q.x = p.x AND q.y = cy.b)"""


@query(f"WITH {_AREA} SELECT f, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, s FROM base")
def plane_area_down(spark, sf_dir):
    return cells(plane.area_down(planes(spark, sf_dir), ["f"], (W, H), _SMALL), "f")


@query(f"WITH {_UP} SELECT f, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, s FROM up")
def plane_bilinear_up(spark, sf_dir):
    base = plane.area_down(planes(spark, sf_dir), ["f"], (W, H), _SMALL)
    return cells(plane.bilinear_up(base, ["f"], _SMALL, (W, H)), "f")


@query(f"""WITH {_UP}, r AS (SELECT pl.f, pl.y, pl.x, pl.s, up.s AS p, sign(pl.s - up.s) * ((abs(pl.s - up.s) + 3) // 7) AS r FROM pl JOIN up USING (f, y, x))
SELECT f, CAST(sum(abs(r)) AS BIGINT) AS size, CAST(count(*) FILTER (r <> 0) AS BIGINT) AS nonzero, CAST(max(abs(greatest(0, least(1023, p + 7 * r)) - s)) AS BIGINT) AS worst FROM r GROUP BY f""")
def scalable_layers(spark, sf_dir):
    """A base layer and its quantised residual: what the residual costs, and the worst error of both put together."""
    p = planes(spark, sf_dir)
    base = plane.area_down(p, ["f"], (W, H), _SMALL)
    r = plane.base_residual(p, base, ["f"], (W, H), _SMALL, 7).withColumnRenamed("s", "was")
    out = plane.with_residual(r, 7, 10)
    one = lambda f, *c: F.aggregate(F.zip_with(*c, f) if len(c) == 2 else F.transform(c[0], f), F.lit(0).cast("bigint"), lambda a, b: a + b)
    worst = F.array_max(F.zip_with("s", "was", lambda a, b: F.abs(a - b)))
    rows = out.select("f", one(F.abs, "r").alias("size"), one(lambda v: F.when(v != 0, 1).otherwise(0).cast("bigint"), "r").alias("nonzero"), worst.alias("worst"))
    return rows.groupBy("f").agg(F.sum("size").alias("size"), F.sum("nonzero").alias("nonzero"), F.max("worst").alias("worst"))


@query(f"WITH {_P} SELECT f, y, x // 2 AS x, s FROM pl WHERE x % 2 = 0 AND false UNION ALL SELECT p.f, p.y, CAST(t.range AS BIGINT), p.s FROM pl p JOIN range(40) t ON p.x = t.range * {W} // 40")
def nearest_scaled(spark, sf_dir):
    return cells(planes(spark, sf_dir).withColumn("s", sample.nearest(F.col("s"), W, 40)), "f")


@query(f"WITH {_X}, r AS (SELECT a.blk, a.i, greatest(0, least(1023, b.s + greatest(0, least(1023, a.s - b.s + 512)) - 512)) AS c FROM x a JOIN x b ON b.blk = a.blk - 1 AND b.i = a.i) SELECT blk, i, c FROM r")
def p_reconstruct(spark, sf_dir):
    """Each vector from the one before and its residual: exact while the residual is not clipped."""
    s = samples(spark, sf_dir)
    both = s.select("blk", "s").join(s.select((F.col("blk") + 1).alias("blk"), F.col("s").alias("ref")), "blk")
    return _long(both, sample.reconstructed(F.col("ref"), sample.residual(F.col("s"), F.col("ref"), 512), 512))


_RGB = "p AS (SELECT blk, i, s & 255 AS v FROM x WHERE i < 60)"



@query(f"""WITH {_X}, {_RGB} SELECT blk, CAST(i // 3 AS BIGINT) AS px, CAST(max(CAST(greatest(least(round_even(CAST(CAST(CAST(v AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) * CAST(1023 AS FLOAT) AS FLOAT), 0), 1023), 0) AS BIGINT)) FILTER (i % 3 = 1) AS BIGINT) AS g,
CAST(max(CAST(greatest(least(round_even(CAST(CAST(CAST(v AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) * CAST(1023 AS FLOAT) AS FLOAT), 0), 1023), 0) AS BIGINT)) FILTER (i % 3 = 2) AS BIGINT) AS b,
CAST(max(CAST(greatest(least(round_even(CAST(CAST(CAST(v AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) * CAST(1023 AS FLOAT) AS FLOAT), 0), 1023), 0) AS BIGINT)) FILTER (i % 3 = 0) AS BIGINT) AS r FROM p GROUP BY blk, i // 3""")
def packed_gbr(spark, sf_dir):
    """Packed rows of 20 pixels (r, g, b of 8 bits) as planes G, B, R."""
    rows = samples(spark, sf_dir).select("blk", F.unhex(F.array_join(F.transform(F.slice("s", 1, 60), lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(255))), 2, "0")), "")).alias("raw"))
    px = block.held(rows, "px", sample.unpacked(F.col("raw"), "rgb24"))
    g, b, r, _ = sample.converted(F.col("px"), "gbr", 255)
    return px.select("blk", F.posexplode(F.arrays_zip(g.alias("g"), b.alias("b"), r.alias("r"))).alias("px", "v")).select("blk", F.col("px").cast("bigint").alias("px"), "v.g", "v.b", "v.r")


def _yuv(mult: int, off: int, cmult: int, coff: int) -> str:
    f = lambda x: f"CAST({x} AS FLOAT)"
    clip = lambda x: f"CAST(greatest(least(round_even({x}, 0), 1023), 0) AS BIGINT)"
    return f"""c AS (SELECT blk, i // 3 AS px, max({f(f(f('v') + ' / ' + f(255)))}) FILTER (i % 3 = 0) AS r, max({f(f(f('v') + ' / ' + f(255)))}) FILTER (i % 3 = 1) AS g, max({f(f(f('v') + ' / ' + f(255)))}) FILTER (i % 3 = 2) AS b FROM p GROUP BY blk, i // 3),
l AS (SELECT *, {f(f(f(0.2126) + ' * r + ' + f(1 - 0.2126 - 0.0722) + ' * g') + ' + ' + f(0.0722) + ' * b')} AS y FROM c),
q AS (SELECT blk, px, {clip(f(f('y * ' + f(mult)) + ' + ' + f(off)))} AS y, {clip(f(f(f(f('b - y') + ' / ' + f(2 * (1 - 0.0722))) + ' + ' + f(0.5)) + ' * ' + f(cmult) + ' + ' + f(coff)))} AS u, {clip(f(f(f(f('r - y') + ' / ' + f(2 * (1 - 0.2126))) + ' + ' + f(0.5)) + ' * ' + f(cmult) + ' + ' + f(coff)))} AS v FROM l)"""


@query(f"""WITH {_X}, {_RGB}, {_yuv(219 * 4, 16 * 4, 224 * 4, 16 * 4)} SELECT blk, CAST(px // 2 AS BIGINT) AS px, CAST(sum(y) AS BIGINT) AS y2, CAST(round_even(avg(u), 0) AS BIGINT) AS u, CAST(round_even(avg(v), 0) AS BIGINT) AS v FROM q GROUP BY blk, px // 2""")
def packed_422(spark, sf_dir):
    """Packed rows as limited-range 4:2:2: chroma quantised first, then halved with halves to even; y2 sums both lumas."""
    rows = samples(spark, sf_dir).select("blk", F.unhex(F.array_join(F.transform(F.slice("s", 1, 60), lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(255))), 2, "0")), "")).alias("raw"))
    px = block.held(rows, "px", sample.unpacked(F.col("raw"), "rgb24"))
    y, u, v, _ = sample.converted(F.col("px"), "422", 255, full=False)
    parts = px
    for name, x in (("y", y), ("u", u), ("v", v)):
        parts = block.held(parts, name, x)
    pairs = F.transform("u", lambda u, i: F.struct(i.alias("px"), (F.get("y", i * 2) + F.get("y", i * 2 + 1)).alias("y2"), u.alias("u"), F.get("v", i).alias("v")))
    return parts.select("blk", F.explode(pairs).alias("x")).select("blk", F.col("x.px").cast("bigint").alias("px"), "x.y2", "x.u", "x.v")


@query(f"WITH {_X} SELECT blk, i, CAST(CAST(greatest(least(round_even(CAST(CAST(CAST(s AS FLOAT) / CAST(1023 AS FLOAT) AS FLOAT) * CAST(4095 AS FLOAT) AS FLOAT), 0), 4095), 0) AS BIGINT) * 16 AS BIGINT) AS c FROM x")
def alpha_convert(spark, sf_dir):
    """Alpha of 10 bits as 12 bits in the upper part of 16."""
    px = samples(spark, sf_dir).withColumn("px", F.transform("s", lambda a: F.struct(a.alias("r"), a.alias("g"), a.alias("b"), a.alias("a"))))
    return _long(px, sample.converted(F.col("px"), "gbr", 1023, shift=4)[3])


# ---- blocks -------------------------------------------------------------------------------------------------

_CELLS = [(0, 0), (4, 0), (0, 4), (4, 4)]


def _inverse(limit: int) -> str:
    order = T.zigzag()[: limit + 1]
    return "w(i, c) AS (VALUES " + ", ".join(f"({i}, {T.weight(i // 8, i % 8)})" for i in order) + ")"


@query(f"""WITH {_F}, {_inverse(9)}, spot(n, xx, yy) AS (VALUES {", ".join(f"({n}, {x}, {y})" for n, (x, y) in enumerate(_CELLS))}),
a AS (SELECT f.blk, spot.n, sum(CAST(f.c AS HUGEINT) * w.c * p.c * q.c) AS a FROM f JOIN w ON w.i = f.i JOIN spot ON true JOIN m p ON p.u = f.i // 8 AND p.k = spot.yy JOIN m q ON q.u = f.i % 8 AND q.k = spot.xx GROUP BY ALL)
SELECT blk, CAST(n AS BIGINT) AS i, CAST(sign(a) * ((abs(a) + 2147483648) // 4294967296) AS BIGINT) AS c FROM a""")
def quarter_decode(spark, sf_dir):
    """Four samples of each block from its first ten coefficients: a decode at a quarter of the size."""
    return block.long_form(block.inverse_at(block.forward(blocks(spark, sf_dir)), _CELLS, 9), "blk")


@query(f"""WITH {_F}, g(i, g) AS (VALUES {", ".join(f"({i}, {T.weight(i // 8, i % 8) * T.E[i // 8] * T.E[i % 8]})" for i in range(64))})
SELECT blk, f.i, CAST(sign(c) * ((abs(c) * 8589934592 + g) // (2 * g)) AS BIGINT) AS c FROM f JOIN g USING (i)""")
def blk_predistort(spark, sf_dir):
    return block.long_form(block.predistort(block.forward(blocks(spark, sf_dir))), "blk")


def _steps(matrix: int, chroma: bool, refined: bool) -> str:
    return "st(i, q) AS (VALUES " + ", ".join(f"({i}, {T.step(matrix, chroma, i, QP, refined)})" for i in range(64)) + ")"


def _quantised(matrix: int, chroma: bool = False, refined: bool = False) -> str:
    return f"WITH {_F}, {_steps(matrix, chroma, refined)} SELECT blk, f.i, CAST(sign(c) * CASE WHEN least(abs(c), {T.MAX_COEFFICIENT}) + q // 2 > CASE WHEN i = 0 THEN 0 ELSE q // 4 END THEN (least(abs(c), {T.MAX_COEFFICIENT}) + q // 2 - CASE WHEN i = 0 THEN 0 ELSE q // 4 END) // q ELSE 0 END AS BIGINT) AS c FROM f JOIN st USING (i)"


def _matrix(number: int, chroma: bool = False, refined: bool = False):
    def run(spark, sf_dir):
        return block.long_form(block.quantise(block.forward(blocks(spark, sf_dir)), QP, number, chroma, refined), "blk")

    run.__name__ = f"quant_matrix_{number}" + "_chroma" * chroma + "_refined" * refined
    return query(_quantised(number, chroma, refined))(run)


for _n, _c, _r in ((1, False, False), (1, True, False), (2, False, False), (3, True, False), (4, False, True)):
    _matrix(_n, _c, _r)


_GRID = f"""{_X}, b AS (SELECT blk // 20 AS sl, blk % 5 AS bx, (blk // 5) % 4 AS yy, blk, i // 8 AS y, i % 8 AS x, s FROM x),
t AS (SELECT c.blk, k.range AS i, n.s FROM (SELECT DISTINCT blk, sl, bx, yy FROM b) c JOIN range(16) k ON true JOIN b n ON n.sl = c.sl AND n.yy = c.yy - 1 AND n.y = 7 AND n.bx * 8 + n.x = least(39, c.bx * 8 + k.range)),
l AS (SELECT c.blk, k.range AS i, n.s FROM (SELECT DISTINCT blk, sl, bx, yy FROM b) c JOIN range(8) k ON true JOIN b n ON n.sl = c.sl AND n.yy = c.yy AND n.bx = c.bx - 1 AND n.x = 7 AND n.y = k.range),
co AS (SELECT c.blk, n.s FROM (SELECT DISTINCT blk, sl, bx, yy FROM b) c JOIN b n ON n.sl = c.sl AND n.yy = c.yy - 1 AND n.bx = c.bx - 1 AND n.x = 7 AND n.y = 7),
mean AS (SELECT blk, (sum(s) + count(*) // 2) // count(*) AS m FROM (SELECT blk, s FROM t WHERE i < 8 UNION ALL SELECT blk, s FROM l) GROUP BY blk),
T AS (SELECT blk, list(s ORDER BY i) AS a FROM t GROUP BY blk), L AS (SELECT blk, list(s ORDER BY i) AS a FROM l GROUP BY blk)"""
_GRID = _GRID.replace("T AS (SELECT blk, list", "tops AS (SELECT blk, list").replace("L AS (SELECT blk, list", "lefts AS (SELECT blk, list")
_PRED = f"""{_GRID}, n AS (SELECT b.blk, b.x, b.y, b.s, coalesce(tops.a, list_transform(range(16), lambda k: CAST(512 AS BIGINT))) AS t, coalesce(lefts.a, list_transform(range(8), lambda k: CAST(512 AS BIGINT))) AS l, coalesce(mean.m, 512) AS m, coalesce(co.s, 512) AS c FROM b LEFT JOIN tops USING (blk) LEFT JOIN lefts USING (blk) LEFT JOIN mean USING (blk) LEFT JOIN co USING (blk)),
p AS (SELECT blk, y * 8 + x AS i, s, [512, m, t[x + 1], l[y + 1], ((7 - x) * l[y + 1] + (x + 1) * t[8] + (7 - y) * t[x + 1] + (y + 1) * l[8] + 8) // 16, CASE WHEN x > y THEN t[x - y] WHEN y > x THEN l[y - x] ELSE c END, t[x + y + 2], l[least(x + y + 2, 8)]] AS p FROM n),
e AS (SELECT blk, i, s, unnest(range(8)) AS mode, unnest(p) AS v FROM p)"""


def _neighbours(spark, sf_dir) -> DataFrame:
    """Blocks in grids of 5 x 4 with the samples above (16), to the left (8) and in the corner; null at the edges."""
    s = samples(spark, sf_dir).select("blk", F.floor(F.col("blk") / 20).alias("sl"), (F.col("blk") % 5).alias("bx"), (F.floor(F.col("blk") / 5) % 4).alias("by"), "s")
    low, right = F.slice("s", 57, 8), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.get("s", j * 8 + 7))
    edges = s.select("*", low.alias("low"), right.alias("right"))
    row, col = Window.partitionBy("sl", "by").orderBy("bx"), Window.partitionBy("sl", "bx").orderBy("by")
    # a row's lower edges first, then one row down
    wide = edges.withColumn("_nl", F.lead("low").over(row)).withColumn("_pl", F.lag("low").over(row)).withColumn("left", F.lag("right").over(row))
    wide = wide.withColumn("_next", F.coalesce("_nl", F.transform("low", lambda _: F.element_at("low", -1))))
    up = wide.withColumn("top", F.lag(F.concat("low", "_next")).over(col)).withColumn("corner", F.lag(F.element_at("_pl", -1)).over(col))
    return up.select("blk", "s", "top", "left", "corner")


@query(f"WITH {_PRED} SELECT blk, CAST(mode AS BIGINT) AS mode, CAST(sum(abs(s - v)) AS BIGINT) AS sad, CAST(sum(v * (i + 1)) AS BIGINT) AS weighed FROM e GROUP BY blk, mode")
def intra_predictions(spark, sf_dir):
    """All eight predictions of each block: their distance, and a weighed sum that tells places apart."""
    n = block.held(_neighbours(spark, sf_dir), "p", plane.intra_candidates(F.col("top"), F.col("left"), F.col("corner"), 512))
    each = n.select("blk", "s", F.posexplode("p").alias("mode", "v"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return each.select("blk", F.col("mode").cast("bigint").alias("mode"), total(F.zip_with("s", "v", lambda a, b: F.abs(a - b))).alias("sad"), total(F.transform("v", lambda v, i: v * (i + 1))).alias("weighed"))


@query(f"""WITH {_PRED}, c AS (SELECT blk, mode, CAST(sum(abs(s - v)) // 16 + CASE WHEN mode = 0 THEN 1 ELSE 4 END AS BIGINT) AS bits, CAST(sum((s - v) * (s - v)) AS BIGINT) AS err FROM e GROUP BY blk, mode),
z AS (SELECT * FROM c WHERE mode = 0), o AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY bits, mode) AS k FROM c WHERE mode > 0),
a AS (SELECT z.blk, CASE WHEN o.bits < z.bits AND o.err <= z.err THEN o.mode ELSE 0 END AS mode, CASE WHEN o.bits < z.bits AND o.err <= z.err THEN o.bits ELSE z.bits END AS bits, CASE WHEN o.bits < z.bits AND o.err <= z.err THEN o.err ELSE z.err END AS err FROM z JOIN o ON o.blk = z.blk AND o.k = 1)
SELECT a.blk, CAST(CASE WHEN o.bits < a.bits AND o.err <= a.err THEN o.mode ELSE a.mode END AS BIGINT) AS mode FROM a JOIN o ON o.blk = a.blk AND o.k = 2""")
def intra_modes(spark, sf_dir):
    """Of the two cheapest predictions the one that takes fewer bits than the middle without a larger error."""
    n = block.held(_neighbours(spark, sf_dir), "p", plane.intra_candidates(F.col("top"), F.col("left"), F.col("corner"), 512))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def cost(v, mode):
        sad, err = total(F.zip_with("s", v, lambda a, b: F.abs(a - b))), total(F.zip_with("s", v, lambda a, b: (a - b) * (a - b)))
        return F.struct(mode.cast("bigint").alias("mode"), (F.floor(sad / 16) + F.when(mode == 0, 1).otherwise(4)).cast("bigint").alias("bits"), err.alias("error"))

    return block.held(n, "costs", F.transform("p", cost)).select("blk", plane.intra_choice(F.col("costs")).alias("mode"))


@query(f"WITH {_F} SELECT label, CAST(sum(abs(c)) FILTER (i > 0) AS BIGINT) AS activity FROM f GROUP BY label")
def ac_activity(spark, sf_dir):
    return block.forward(blocks(spark, sf_dir)).select("label", metric.activity(F.col("coef")).alias("a")).groupBy("label").agg(F.sum("a").alias("activity"))


_CPLX = f"""{_X}, d AS (SELECT blk, avg(abs(n - s)) AS c FROM (SELECT blk, i, s, lead(s, 4) OVER (PARTITION BY blk ORDER BY i) AS n FROM x) WHERE i % 4 = 0 AND n IS NOT NULL GROUP BY blk)"""


@query(f"WITH {_CPLX} SELECT blk, round(c, 6) AS complexity FROM d")
def row_complexity(spark, sf_dir):
    return samples(spark, sf_dir).select("blk", F.round(metric.complexity(F.col("s")), 6).alias("complexity"))


@query(f"""WITH RECURSIVE {_CPLX}, k AS (SELECT blk // 100 AS g, blk % 100 AS k, blk, c, lag(c) OVER (PARTITION BY blk // 100 ORDER BY blk) AS p FROM d),
j AS (SELECT *, coalesce(c > p * 1.2 OR c < p / 1.2, false) AS jump FROM k),
r AS (SELECT g, k, CASE WHEN jump AND k + 16 >= 8 THEN k ELSE -16 END AS last, jump AS anchor FROM j WHERE k = 0
UNION ALL SELECT j.g, j.k, CASE WHEN j.jump AND j.k - r.last >= 8 THEN j.k ELSE r.last END, j.jump AND j.k - r.last >= 8 FROM r JOIN j ON j.g = r.g AND j.k = r.k + 1)
SELECT g, k, anchor FROM r""")
def reanchor(spark, sf_dir):
    """Sequences of 100 rows: where the complexity jumps by a fifth, at least eight rows after the last such place."""
    c = samples(spark, sf_dir).select(F.floor(F.col("blk") / 100).cast("bigint").alias("g"), (F.col("blk") % 100).alias("k"), metric.complexity(F.col("s")).alias("complexity"))
    return control.anchors(c, ["g"], "k", 1.2).select("g", "k", "anchor")


@query(f"""WITH RECURSIVE {_X}, r AS (SELECT a.blk // 100 AS g, a.blk, CAST(sum(abs(a.s - coalesce(b.s, 512))) // 64 AS BIGINT) AS mad, CAST(sum(abs(a.s - coalesce(b.s, 512))) AS BIGINT) AS pb, CAST(sum(abs(a.s - 512)) AS BIGINT) AS ib FROM x a LEFT JOIN x b ON b.blk = a.blk - 1 AND b.i = a.i GROUP BY a.blk),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY blk) - 1 AS n FROM r),
t AS (SELECT g, n, blk, ib AS last, 'I' AS type FROM k WHERE n % 12 = 0
UNION ALL SELECT k.g, k.n, k.blk, CASE WHEN k.mad < 64 AND k.pb < t.last THEN t.last ELSE k.ib END, CASE WHEN k.mad < 64 AND k.pb < t.last THEN 'P' ELSE 'I' END FROM t JOIN k ON k.g = t.g AND k.n = t.n + 1 WHERE k.n % 12 <> 0)
SELECT g, n // 12 AS segment, blk, type FROM t""")
def frame_types(spark, sf_dir):
    """I or P for each vector against the one before, in segments of 12 that begin with an I."""
    s = samples(spark, sf_dir)
    both = s.select("blk", "s").join(s.select((F.col("blk") + 1).alias("blk"), F.col("s").alias("ref")), "blk", "left")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    p = total(F.transform("s", lambda v, i: F.abs(v - F.coalesce(F.get("ref", i), F.lit(512)))))
    costs = both.select(F.floor(F.col("blk") / 100).cast("bigint").alias("g"), "blk", F.floor(p / 64).cast("bigint").alias("mad"), p.alias("p_bytes"), total(F.transform("s", lambda v: F.abs(v - 512))).alias("i_bytes"))
    return control.frame_types(costs, ["g"], ["blk"], 12, 12).select("g", "segment", "blk", "type")

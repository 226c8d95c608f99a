"""Queries over entropy coders: each block is a slice of one block, each label's histogram a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from planeframe.functions import binary as B
from planeframe.operators import block, coder, metric, sample
from planeframe.queries import _F, _FR, _RL, _S, _X, _Z, QP, _long, _q, _scanned, blocks, frames, query, samples, table

_LEVELS = f"WITH {_F}, {_q(QP)}, {_Z}, {_S}, {_RL}"
_FOLD = "CASE WHEN {0} >= 0 THEN 2 * {0} ELSE -2 * {0} - 1 END"


def _rice(m: str, k: str) -> str:
    """Bit text of the Rice code of m under k."""
    low = f"right(lpad(bin({m}), 64, '0'), CAST({{}} AS INTEGER))"
    return f"CASE WHEN {m} >> CAST({k} AS INTEGER) <= 30 THEN repeat('1', CAST({m} >> CAST({k} AS INTEGER) AS INTEGER)) || '0' || CASE WHEN {k} > 0 THEN {low.format(k)} ELSE '' END ELSE repeat('1', 31) || {low.format('32')} END"


def one_block_slices(spark, sf_dir) -> DataFrame:
    """id, label, coef (scan order), pairs, tokens: one token each, DC predicted from nothing."""
    b = _scanned(spark, sf_dir).withColumn("pred", F.lit(0).cast("bigint"))
    return coder.tokens(b).select(F.col("blk").alias("id"), "label", "coef", "pairs", F.array("token").alias("tokens"))


def _k(total: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 OR {total} // greatest({n}, 1) < 1 THEN 0 ELSE least(14, CAST(floor(log2({total} // greatest({n}, 1)) + 1e-9) AS BIGINT)) END"


_RICE_SLICE = f"""{_LEVELS}, d AS (SELECT blk, {_FOLD.format('c')} AS m FROM s WHERE i = 0),
n AS (SELECT blk, count(*) AS n, sum(run) AS runs, sum({_FOLD.format('level')}) AS levels FROM rl GROUP BY blk),
k AS (SELECT d.blk, d.m, CAST({_k('d.m', '1')} AS BIGINT) AS k1, CAST({_k('coalesce(levels, 0)', 'coalesce(n, 0)')} AS BIGINT) AS k2, CAST({_k('coalesce(runs, 0)', 'coalesce(n, 0)')} AS BIGINT) AS k3 FROM d LEFT JOIN n USING (blk)),
t AS (SELECT k.blk, string_agg({_rice('rl.run', 'k.k3')} || {_rice('(' + _FOLD.format('rl.level') + ')', 'k.k2')}, '' ORDER BY rl.i) AS b FROM rl JOIN k USING (blk) GROUP BY k.blk),
b AS (SELECT k.blk, k1, k2, k3, {_rice('k.m', 'k.k1')} || coalesce(t.b, '') || {_rice('63', 'k.k3')} AS b FROM k LEFT JOIN t USING (blk))"""


@query(f"{_RICE_SLICE} SELECT blk AS id, k1, k2, k3, CAST(length(b) AS BIGINT) AS bits, hex(unbin(rpad(b, CAST((length(b) + 7) // 8 * 8 AS INTEGER), '0'))) AS payload FROM b")
def rice_payload(spark, sf_dir):
    """Parameters and bytes of each block's Rice code."""
    s = coder.rice_slice(one_block_slices(spark, sf_dir))
    pairs = lambda f: F.aggregate(F.get("tokens", F.lit(0))["pairs"], F.lit(0).cast("bigint"), lambda a, p: a + f(p))
    bits = block.rice_bits(F.get("tokens", F.lit(0))["dc"], F.col("k1")) + pairs(lambda p: block.rice_bits(p["run"], F.col("k3")) + block.rice_bits(p["level"], F.col("k2"))) + block.rice_bits(F.lit(coder.EOB).cast("bigint"), F.col("k3"))
    return s.select("id", "k1", "k2", "k3", bits.alias("bits"), F.hex("payload").alias("payload"))


@query(f"WITH {_F}, {_q(QP)}, {_Z}, {_S} SELECT blk AS id, i, c FROM s")
def rice_roundtrip(spark, sf_dir):
    """What the decoder makes of the Rice payloads: the coefficients in scan order."""
    s = coder.rice_slice(one_block_slices(spark, sf_dir)).withColumn("n", F.lit(1)).withColumn("width", F.lit(1))
    return _coefficients(coder.rice_decode(s))


def _coefficients(decoded: DataFrame) -> DataFrame:
    return decoded.select("id", F.posexplode(F.get("blocks", F.lit(0))).alias("i", "c")).select("id", F.col("i").cast("bigint").alias("i"), "c")


_SYMBOLS = {"dc": 29, "level": 28, "run": 64}


def _books() -> dict[str, list[int]]:
    """Code lengths by a rule: the weight of a symbol falls by half every third one; no code over 16 bits. Runs have
    their end mark among the frequent ones."""
    weights = {f: [(1 << 20) >> (i // 3) for i in range(n)] for f, n in _SYMBOLS.items()}
    weights["run"][coder.EOB] = 1 << 19
    return {f: coder.limited_lengths([max(1, w) for w in ws], 16) for f, ws in weights.items()}


BOOKS = _books()


def _codes(lengths: list[int]) -> list[str]:
    order, code, before, out = sorted((n, s) for s, n in enumerate(lengths) if n), 0, 0, [""] * len(lengths)
    for n, s in order:
        code <<= n - before
        out[s], code, before = format(code, f"0{n}b"), code + 1, n
    return out


def _book_sql(family: str) -> str:
    return f"[{', '.join(repr(c) for c in _codes(BOOKS[family]))}]"


def _vlc_value(book: str, m: str) -> str:
    cat = f"CASE WHEN {m} > 0 THEN length(bin({m})) ELSE 0 END"
    return f"{book}[{cat} + 1] || CASE WHEN {m} > 1 THEN right(bin({m}), length(bin({m})) - 1) ELSE '' END"


def vlc_slices(spark, sf_dir) -> DataFrame:
    arrays = [F.array(*[F.lit(c) for c in _codes(BOOKS[f])]) for f in ("dc", "level", "run")]
    return coder.vlc_slice(one_block_slices(spark, sf_dir), *arrays)


@query(f"""{_LEVELS}, k AS (SELECT {_book_sql('dc')} AS dc, {_book_sql('level')} AS lv, {_book_sql('run')} AS rn), d AS (SELECT blk, {_FOLD.format('c')} AS m FROM s WHERE i = 0),
t AS (SELECT blk, string_agg(rn[run + 1] || {_vlc_value('lv', '(' + _FOLD.format('level') + ')')}, '' ORDER BY i) AS b FROM rl, k GROUP BY blk),
b AS (SELECT blk, {_vlc_value('dc', 'm')} || coalesce(t.b, '') || rn[64] AS b FROM d LEFT JOIN t USING (blk), k)
SELECT blk AS id, hex(unbin(rpad(b, CAST((length(b) + 7) // 8 * 8 AS INTEGER), '0'))) AS payload FROM b""")
def vlc_payload(spark, sf_dir):
    """Bytes of each block under canonical codes."""
    return vlc_slices(spark, sf_dir).select("id", F.hex("payload").alias("payload"))


@query(f"WITH {_F}, {_q(QP)}, {_Z}, {_S} SELECT blk AS id, i, c FROM s")
def vlc_roundtrip(spark, sf_dir):
    s = vlc_slices(spark, sf_dir).withColumn("n", F.lit(1)).withColumn("width", F.lit(1))
    return _coefficients(coder.vlc_decode(s, BOOKS["dc"], BOOKS["level"], BOOKS["run"]))


def lengths(spark, sf_dir) -> DataFrame:
    """p_brand, lens: code lengths of the sizes 1 to 50 that fill a code exactly: 1, 2, ... 15, 15 in turn."""
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.count("*") % 14 + 2).alias("n"))
    return n.select("p_brand", "n", F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n") + 1), lambda i: F.least(i, F.col("n"))).alias("lens"))


_LENS = "n AS (SELECT p_brand, count(*) % 14 + 2 AS n FROM part GROUP BY p_brand), l AS (SELECT p_brand, n, unnest(range(1, n + 2)) - 1 AS s, least(unnest(range(1, n + 2)), n) AS len FROM n)"


@query(f"""WITH {_LENS}, c AS (SELECT p_brand, n, s, len, coalesce(sum(CAST(pow(2, n - len) AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY len, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT p_brand, CAST(s AS BIGINT) AS sym, lpad(bin(CAST(before // pow(2, n - len) AS BIGINT)), CAST(len AS INTEGER), '0') AS code FROM c""")
def canonical_codes(spark, sf_dir):
    """The codes of each brand's lengths, counting up by length and symbol."""
    each = lengths(spark, sf_dir).select("p_brand", F.posexplode(coder.canonical(F.col("lens"))).alias("sym", "code"))
    return each.select("p_brand", F.col("sym").cast("bigint").alias("sym"), "code")


@query(f"WITH {_LENS} SELECT p_brand, sum(CAST(pow(2, 20 - len) AS BIGINT)) = 1048576 AS whole, sum(CASE WHEN s > 0 THEN CAST(pow(2, 20 - len) AS BIGINT) ELSE 0 END) = 1048576 AS without_first FROM l GROUP BY p_brand")
def kraft(spark, sf_dir):
    """Whether the lengths fill the code, and whether they still do without the first symbol."""
    n = lengths(spark, sf_dir)
    less = F.transform("lens", lambda x, i: F.when(i == 0, 0).otherwise(x))
    return n.select("p_brand", coder.kraft(F.col("lens"), 20).alias("whole"), coder.kraft(less, 20).alias("without_first"))


_BOOKS4 = [coder.limited_lengths([max(1, (1 << 16) >> (i // d)) for i in range(28)], 16) for d in (1, 2, 4, 9)]


@query(f"""{_LEVELS}, h AS (SELECT label, CASE WHEN m > 0 THEN length(bin(m)) ELSE 0 END AS sym, count(*) AS c FROM (SELECT label, {_FOLD.format('level')} AS m FROM rl) GROUP BY ALL),
b(book, sym, len) AS (VALUES {", ".join(f"({b}, {s}, {n})" for b, ls in enumerate(_BOOKS4) for s, n in enumerate(ls))}),
t AS (SELECT label, book, sum(c * (len + greatest(h.sym - 1, 0))) AS bits FROM h JOIN b USING (sym) GROUP BY ALL)
SELECT label, CAST(arg_min(book, bits * 10 + book) AS BIGINT) AS book, CAST(min(bits) AS BIGINT) AS bits FROM t GROUP BY label""")
def best_book(spark, sf_dir):
    """The cheapest of four books for the levels of each label."""
    levels = _scanned(spark, sf_dir).select("label", F.explode("pairs").alias("p")).select("label", coder.category(block.fold(F.col("p.level"))).alias("sym"))
    hist = levels.groupBy("label", "sym").agg(F.count("*").alias("c"))
    books = spark.createDataFrame([(b, s, n) for b, ls in enumerate(_BOOKS4) for s, n in enumerate(ls)], "book bigint, sym bigint, len bigint")
    return coder.best_book(hist, books, ["label"], True)


_SEQ = f"{_FR}, sy AS (SELECT user_id, ts, event_id, size % 16 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM fr)"


def sequences(spark, sf_dir) -> DataFrame:
    """id, seq: each user's frame sizes modulo 16 in order."""
    f = frames(spark, sf_dir).select("user_id", F.struct("ts", "event_id", (F.col("size") % 16).alias("s")).alias("x"))
    return f.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("seq"))


def _sequence_rows(decoded: DataFrame) -> DataFrame:
    return decoded.select("id", F.posexplode("seq").alias("i", "s")).select("id", F.col("i").cast("bigint").alias("i"), "s")


@query(f"WITH {_SEQ} SELECT user_id AS id, i, CAST(s AS BIGINT) AS s FROM sy")
def rans_roundtrip(spark, sf_dir):
    """Each user's symbols through their own model and back."""
    return _sequence_rows(coder.rans_symbols(coder.rans_slices(sequences(spark, sf_dir), 16)))


@query(f"WITH {_SEQ} SELECT user_id AS id, i, CAST(s AS BIGINT) AS s FROM sy")
def rans_context_roundtrip(spark, sf_dir):
    """The same with a model for each of five contexts: the symbol before."""
    return _sequence_rows(coder.rans_symbols(coder.rans_slices(sequences(spark, sf_dir), 16, 5)))


@query(f"WITH {_SEQ} SELECT user_id AS id, count(*) AS n, CAST(4096 AS BIGINT) AS total, CAST(count(DISTINCT s) AS BIGINT) AS used FROM sy GROUP BY user_id")
def rans_models(spark, sf_dir):
    """Each model sums up to 4096 and has a share for every symbol that occurs."""
    s = coder.rans_slices(sequences(spark, sf_dir), 16)
    f = F.get("freq", F.lit(0))
    return s.select("id", "n", F.aggregate(f, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"), F.size(F.filter(f, lambda v: v > 0)).cast("bigint").alias("used"))


_MED = f"""{_X}, n AS (SELECT blk, i, s, lag(s) OVER (PARTITION BY blk, i // 8 ORDER BY i) AS l, lag(s, 8) OVER (PARTITION BY blk ORDER BY i) AS t FROM x),
c AS (SELECT *, lag(t) OVER (PARTITION BY blk, i // 8 ORDER BY i) AS c FROM n),
r AS (SELECT blk, i, s - CASE WHEN l IS NULL AND t IS NULL THEN 0 WHEN t IS NULL THEN l WHEN l IS NULL THEN t WHEN c >= greatest(l, t) THEN least(l, t) WHEN c <= least(l, t) THEN greatest(l, t) ELSE l + t - c END AS r FROM c)"""


def _residuals(spark, sf_dir) -> DataFrame:
    """id, residuals: of every second bit plane, so that there are zeros."""
    coarse = samples(spark, sf_dir).withColumn("s", F.transform("s", lambda v: F.floor(v / 64).cast("bigint")))
    return coarse.select(F.col("blk").alias("id"), F.transform(sample.med_residuals(F.col("s"), 8), lambda x: x["resid"]).alias("residuals"))


@query(f"""WITH {_MED.replace("s FROM x)", "s // 64 AS s FROM x)", 1).replace("lag(s) OVER (PARTITION BY blk, i // 8 ORDER BY i) AS l, lag(s, 8) OVER (PARTITION BY blk ORDER BY i) AS t FROM x", "lag(s // 64) OVER (PARTITION BY blk, i // 8 ORDER BY i) AS l, lag(s // 64, 8) OVER (PARTITION BY blk ORDER BY i) AS t FROM x").replace("SELECT blk, i, s, lag", "SELECT blk, i, s // 64 AS s, lag")},
z AS (SELECT blk, i, r FROM r WHERE r <> 0 UNION ALL SELECT blk, 64, 0 FROM (SELECT blk, arg_max(r, i) AS last FROM r GROUP BY blk) WHERE last = 0)
SELECT blk AS id, CAST(row_number() OVER (PARTITION BY blk ORDER BY i) - 1 AS BIGINT) AS at, CAST(i - coalesce(lag(i) OVER (PARTITION BY blk ORDER BY i), -1) - 1 AS BIGINT) AS run, CAST(r AS BIGINT) AS level FROM z""")
def alpha_pairs(spark, sf_dir):
    """Runs and levels of each block's alpha residuals, with the mark of zeros at the end."""
    each = _residuals(spark, sf_dir).select("id", F.posexplode(coder.residual_pairs(F.col("residuals"))).alias("at", "p"))
    return each.select("id", F.col("at").cast("bigint").alias("at"), "p.run", "p.level")


@query(f"WITH {_X} SELECT blk, i, s // 64 AS c FROM x")
def alpha_roundtrip(spark, sf_dir):
    """The samples that come out of the pairs: expanded, then predicted from what was decoded before."""
    r = block.held(_residuals(spark, sf_dir), "pairs", coder.residual_pairs(F.col("residuals")))
    back = r.select("id", F.lit(8).alias("width"), coder.pair_residuals(F.col("pairs")).alias("residuals"))
    return _long(coder.med_decode(back).withColumnRenamed("id", "blk"), F.col("samples"))


@query(f"WITH {_X} SELECT blk, i, s // 64 AS c FROM x")
def alpha_payload_roundtrip(spark, sf_dir):
    """Alpha bands through their bytes: Rice runs and levels out and in, then the samples predicted from one another."""
    r = _residuals(spark, sf_dir).withColumn("count", F.size("residuals"))
    back = coder.residual_decode(coder.residual_slice(r)).select("id", F.lit(8).alias("width"), "residuals")
    return _long(coder.med_decode(back).withColumnRenamed("id", "blk"), F.col("samples"))


@query(f"""{_LEVELS}, c AS (SELECT label, blk, i, run, {_FOLD.format('level')} AS m, lag(level) OVER (PARTITION BY blk ORDER BY i) AS p FROM rl),
k AS (SELECT *, length(bin(m)) AS cat, CASE WHEN p IS NULL THEN NULL ELSE length(bin({_FOLD.format('p')})) END AS pc FROM c)
SELECT label, CAST(CASE WHEN i < 8 THEN 0 WHEN i < 16 THEN 1 WHEN i < 32 THEN 2 ELSE 3 END AS BIGINT) AS place, CAST(CASE WHEN pc IS NULL THEN 4 WHEN pc = 0 THEN 0 WHEN pc = 1 THEN 1 WHEN pc <= 3 THEN 2 ELSE 3 END AS BIGINT) AS prev,
CAST(CASE WHEN i < 5 THEN 0 WHEN i < 11 THEN 1 WHEN i < 17 THEN 2 WHEN i < 25 THEN 3 ELSE 4 END AS BIGINT) AS band, CAST(cat AS BIGINT) AS cat, count(*) AS n FROM k GROUP BY ALL""")
def token_contexts(spark, sf_dir):
    """The histogram of level categories by place, the level before, and band."""
    each = _contexts(spark, sf_dir)
    return each.groupBy("label", "place", "prev", "band", "cat").agg(F.count("*").alias("n"))


def _contexts(spark, sf_dir) -> DataFrame:
    b = _scanned(spark, sf_dir)
    cat = lambda i: coder.category(block.fold(F.get("pairs", i)["level"]))
    # the scan position: all runs and levels so far
    at = lambda i: F.aggregate(F.slice("pairs", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, p: a + p["run"] + 1)
    t = F.transform("pairs", lambda p, i: F.struct(coder.place_context(at(i)).alias("place"), coder.previous_context(F.when(i > 0, cat(i - 1))).alias("prev"), coder.band(at(i)).alias("band"), cat(i).alias("cat")))
    return b.select("label", F.explode(t).alias("t")).select("label", "t.*")


def _entropy(by: str) -> str:
    return f"(SELECT label, sum(b) AS b FROM (SELECT label, {by} AS x, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS b FROM (SELECT label, {by}, cat, count(*) AS n FROM cq GROUP BY ALL) GROUP BY ALL) GROUP BY label)"


_CTX = f"""{_LEVELS}, c AS (SELECT label, blk, i, {_FOLD.format('level')} AS m, lag(level) OVER (PARTITION BY blk ORDER BY i) AS p FROM rl),
cq AS (SELECT label, length(bin(m)) AS cat, 0 AS one, CASE WHEN i < 8 THEN 0 WHEN i < 16 THEN 1 WHEN i < 32 THEN 2 ELSE 3 END AS place,
CASE WHEN p IS NULL THEN 4 WHEN length(bin({_FOLD.format('p')})) = 1 THEN 1 WHEN length(bin({_FOLD.format('p')})) <= 3 THEN 2 ELSE 3 END AS prev FROM c)"""


@query(f"""{_CTX}, j AS (SELECT a.label, a.b + 8 * 28 AS a, b.b + 8 * 4 * 28 AS b, c.b + 8 * 5 * 28 AS c, a.b AS a0, b.b AS b0, c.b AS c0 FROM {_entropy('one')} a JOIN {_entropy('place')} b USING (label) JOIN {_entropy('prev')} c USING (label))
SELECT label, round(least(a0, b0 - 2, c0 - 2), 6) AS adaptive, CASE WHEN b < a THEN CASE WHEN c < b THEN 'prev' ELSE 'place' END WHEN c < a THEN 'prev' ELSE 'none' END AS model FROM j""")
def context_model(spark, sf_dir):
    """The cheapest context model of each label's levels, tables included, and the adaptive bound without them."""
    each = _contexts(spark, sf_dir).withColumn("one", F.lit(0))
    costs = None
    for name in ("one", "place", "prev"):
        c = metric.context_cost(each, ["label"], name, "cat").withColumnRenamed("bits", name)
        costs = c if costs is None else costs.join(c, "label")
    model = metric.cheapest([(n, F.col(col) + 8 * k * 28) for n, col, k in (("none", "one", 1), ("place", "place", 4), ("prev", "prev", 5))])
    return costs.select("label", F.round(metric.adaptive_bits(F.col("one"), F.col("place"), F.col("prev")), 6).alias("adaptive"), model.alias("model"))


@query(f"""WITH {_F}, {_q(QP)}, d AS (SELECT blk, blk // 20 AS slice, {_FOLD.format('c')} AS m FROM q WHERE i = 0), dp AS (SELECT blk, CASE WHEN lag(m) OVER w IS NULL THEN -1 WHEN lag(m) OVER w = 0 THEN 0 ELSE length(bin(lag(m) OVER w)) END AS cat FROM d WINDOW w AS (PARTITION BY slice ORDER BY blk))
SELECT blk, CAST(CASE WHEN cat < 0 THEN 0 WHEN cat <= 1 THEN 1 + cat WHEN cat <= 3 THEN 3 ELSE 4 END AS BIGINT) AS ctx FROM dp""")
def dc_contexts(spark, sf_dir):
    """Each block's bucket by the DC of the block before in its slice."""
    d = block.quantise(block.forward(blocks(spark, sf_dir)), QP).select("blk", F.floor(F.col("blk") / 20).alias("slice"), coder.category(block.fold(F.get("coef", F.lit(0)))).alias("cat"))
    return d.select("blk", coder.dc_context(F.lag("cat").over(Window.partitionBy("slice").orderBy("blk"))).alias("ctx"))


@query(f"""WITH c AS (SELECT c_custkey, CAST(abs(round(c_acctbal)) AS BIGINT) AS m, c_custkey % 15 AS k FROM customer) SELECT c_custkey, {_rice('m', 'k')} AS code, m <= 131072 AS ok, CAST(CASE WHEN m = 0 THEN 64 ELSE length(bin(m)) - length(rtrim(bin(m), '0')) END AS BIGINT) AS zeros FROM c""")
def rice_symbols(spark, sf_dir):
    """Rice codes of balances as bit text, whether they are in the alpha levels' domain, and their trailing zero bits."""
    m = F.abs(F.round("c_acctbal")).cast("bigint")
    c = table(spark, sf_dir, "customer").select("c_custkey", m.alias("m"), (F.col("c_custkey") % 15).alias("k"))
    return c.select("c_custkey", coder.rice_code(F.col("m"), F.col("k")).alias("code"), coder.in_domain(F.col("m"), "alpha").alias("ok"), B.trailing_zeros(F.col("m")).alias("zeros"))
